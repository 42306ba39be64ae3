"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e is split into e + 1 pieces: wherever a text holds the item with at most e edits, one piece is
there unchanged. All pieces are found by one Aho-Corasick pass; around each hit Myers' bit-parallel algorithm gives the
smallest edit distance of the item to any span of the text. Both sides are compared as lower-cased UTF-8 with
each run of ASCII other than letters and digits as one space, and edits count bytes of that. Short items have no budget and match between
word boundaries alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, rows_where, small_batches

_KEPT = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
#: Bytes of item texts that one automaton is built of at most.
BLOCK = 4_000_000


def normalized(texts: list[str | None]) -> tuple[str, np.ndarray]:
    """All texts as one string with a character for each byte, and where each begins. A zero byte, which no text keeps, ends each."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass").replace(b"\0", b" ") for t in texts]
    buf = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    out = np.where(_KEPT[buf], buf, np.uint8(32))
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    out[ends] = 0
    keep = out != 32
    keep[1:] |= _KEPT[buf[:-1]]
    at = np.cumsum(keep)[ends]
    return out[keep].tobytes().decode("latin-1"), np.concatenate([[0], at])


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """Offset and text of errors + 1 pieces of about the same length."""
    cuts = [len(text) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """Smallest edit distance of pattern to a span of text, and that span's end, the first of equals; (most + 1, -1) if over most."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, score, best, end = full, 0, len(pattern), most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        across = ((((eq & up) + up) ^ up) | eq | down) & full
        left_up, left_down = (down | ~(across | up)) & full, up & across
        score += bool(left_up & top) - bool(left_down & top)
        if score < best:
            best, end = score, j + 1
        left_up = left_up << 1 & full
        left_down = left_down << 1 & full
        eq |= down
        up, down = (left_down | ~(eq | left_up)) & full, left_up & eq
    return best, end


def _matcher(items: list[tuple[int, str]], rate: float, least: int):
    """The automaton of all pieces, and each item's error budget: -1 for one of under `least` bytes, whose only piece is the whole item."""
    import ahocorasick

    held: dict[str, list[tuple[int, int]]] = {}
    errors = [int(len(t) * rate) if len(t) >= least else -1 for _, t in items]
    for i, (_, t) in enumerate(items):
        for at, piece in pieces(t, max(0, errors[i])):
            held.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, where in held.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, errors


def matches(texts: list[str | None], items: list[tuple[int, str]], automaton, errors: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end) of the best match of each item in each text; start and end count normalised bytes."""
    whole, first = normalized(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for last, (size, where) in automaton.iter(whole):
        at = last + 1 - size
        doc = int(np.searchsorted(first, at, "right")) - 1
        for i, offset in where:
            e, begin = errors[i], at - offset
            if best.get((doc, i), (1,))[0] == 0 or (doc, i, begin) in tried:
                continue
            tried.add((doc, i, begin))
            if e < 0:
                if whole[begin - 1 : begin] in ("", " ", "\0") and whole[last + 1] in " \0":
                    best[doc, i] = (0, last + 1, begin)
                continue
            lo, hi = max(int(first[doc]), begin - e), min(int(first[doc + 1]) - 1, begin + len(items[i][1]) + e)
            if hi - lo < len(items[i][1]) - e:
                continue
            if begin >= lo and whole.startswith(items[i][1], begin):
                d, end, start = 0, begin + len(items[i][1]), begin
            else:
                d, end = myers(items[i][1], whole[lo:hi], e)
                if d > e:
                    continue
                _, back = myers(items[i][1][::-1], whole[lo : lo + end][::-1], d)
                start, end = lo + end - back, lo + end
            if (doc, i) not in best or (d, start) < best[doc, i][::2]:
                best[doc, i] = (d, end, start)
    return [(doc, i, d, start - int(first[doc]), end - int(first[doc])) for (doc, i), (d, end, start) in sorted(best.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items (item_id, normalised text) that aren't empty, in blocks of a few MB."""
    sized = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null")
    count = int((sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK) + 1
    for block in range(count):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()
        items = sorted({(r["item_id"], normalized([r["text"]])[0][:-1].strip(" ")) for r in rows}, key=str)
        items = [(k, t) for k, t in items if t]
        if items:
            yield items


def clean_rows(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 24) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark as find() understands it. Null and empty texts hold none; of repeated rows
    all stay or all go; without items every row stays, and without rows there are none."""

    def clean(items: list[tuple[int | None, str]]) -> Callable[[list[str | None]], np.ndarray]:
        built: list = []

        def keep(texts: list[str | None]) -> np.ndarray:
            if not built:
                built.extend(_matcher(items, rate, least))
            out = np.ones(len(texts), bool)
            out[[m[0] for m in matches(texts, items, *built)]] = False
            return out

        return keep

    for items in item_blocks(benchmark):
        docs = rows_where(docs, clean(items))
    return docs


def find(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 24) -> DataFrame:
    """Benchmark items (item_id, text) found in docs (doc_id, text) with at most rate * length edits: doc_id, item_id, distance, and start and end
    in bytes of the normalised text, for the best match (least distance, then first) of each item in each document.

    Null and empty texts match nothing, nor do items without a letter or digit. Items of under `least` normalised bytes match as they are, at word
    boundaries. Equal items are found each; repeated rows of docs
    give their matches each; a null doc_id is kept, as is a null item_id. Other columns are ignored. Texts are taken whole. Items are taken in blocks
    of bounded size, with one pass over docs for each, so that a benchmark may be of any size. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = None
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            automaton, errors = _matcher(items, rate, least)
            for batch in bounded(batches):
                found = matches(batch.column("text").to_pylist(), items, automaton, errors)
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_pylist([{"doc_id": ids[d], "item_id": items[i][0], "distance": e, "start": s, "end": t} for d, i, e, s, t in found], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

        found = docs.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)
