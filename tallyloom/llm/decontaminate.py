"""Benchmark decontamination: every training passage queries a BM25 inverted index of test items with block-max WAND.

Items are indexed in units of at most ``UNIT`` words; passages are windows of 2 * ``STRIDE`` words every ``STRIDE``, so
each unit's copy lies whole within some passage. Impacts are divided by the unit's score against itself, so one
threshold fits all. A passage can only reach it if it holds enough of some unit's strongest terms (that share of WAND's
bound needs no postings but those terms'), which is tested for all passages of a batch at once; those that can are
searched with block maxima, and what they retrieve is verified against the document: question and answer must overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean, named, quoted
from .words import PUNCTUATED, U64, grouped, mix, texts_word_hashes

UNIT, STRIDE, BLOCK = 48, 48, 64
K1, B = 1.2, 0.75
#: Least share of a unit's own score for retrieval; least shares of an item's shingles in a document for each part.
RETRIEVE, OVERLAP, SHINGLE = 0.5, 0.6, 5
#: UTF-8 bytes of item texts in one index; more items make more indexes, one after another.
INDEX_BYTES = 32 << 20


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence or line is the answer; a single sentence has no answer."""
    cut = [m.end() for m in re.finditer(r"[.!?](?=\s)|\n", text.rstrip())]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles."""
    if not 0 < k <= len(h):
        return np.zeros(0, U64)
    s = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        s = s + h[j : len(h) - k + 1 + j] * U64(0x9E3779B97F4A7C15 * (2 * j + 3) % (1 << 64) | 1)
    return np.unique(mix(s + U64(k)))


def _width(n: int) -> int:
    """Shingle width for an answer of n words: narrow enough that one changed word leaves ``OVERLAP`` of the shingles
    (of three words or more), at most ``SHINGLE``."""
    return min(SHINGLE, max(1, (n + 1) * 2 // 7)) if n else 0


def _words(text: str) -> np.ndarray:
    return texts_word_hashes([text.encode("utf-8", "surrogatepass")], PUNCTUATED)[0]


def _units(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in units of about equal length, at most ``UNIT``."""
    return np.array_split(words, -(-len(words) // UNIT)) if len(words) else []


class BlockMaxIndex:
    """Postings of (unit, relative impact) by term, in blocks with their greatest impact.

    ``statistics``: (number of units, mean length, terms in order, units with each) of all items, of which ``items``
    are a part that holds those terms; by default those of ``items``.
    """

    def __init__(self, items: list[tuple[int, str]], retrieve: float = RETRIEVE, statistics: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        self.retrieve, self.item_ids, self.parts, units = retrieve, [], [], []
        for item_id, text in items:
            question, answer = map(_words, split_item(text))
            words = np.concatenate([question, answer])
            if not len(words):
                continue
            self.item_ids.append(item_id)
            #: (shingle width, shingles) of question and answer; a question of fewer words is one shingle
            self.parts.append([(k, _shingles(w, k)) for w, k in ((question, min(SHINGLE, len(question))), (answer, _width(len(answer))))])
            units += [(len(self.item_ids) - 1, w) for w in _units(words)]
        self.unit_item = np.array([i for i, _ in units], np.int64)
        tf = [np.unique(w, return_counts=True) for _, w in units]
        terms, df = np.unique(np.concatenate([t for t, _ in tf]) if tf else np.zeros(0, U64), return_counts=True)
        count, mean = len(units), np.mean([len(w) for _, w in units]) if units else 1.0
        if statistics is not None:
            count, mean, known, all_df = statistics
            df = all_df[np.searchsorted(known, terms)]
        idf = np.log1p((count - df + 0.5) / (df + 0.5))
        rows = []
        for u, ((t, c), (_, w)) in enumerate(zip(tf, units, strict=True)):
            at = np.searchsorted(terms, t)
            impact = idf[at] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean))
            rows.append((at, np.full(len(at), u), impact / impact.sum()))
        term, unit, impact = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((unit, term))
        self.terms, self.post_unit, self.post_impact = terms, unit[order], impact[order].astype(float)
        self.starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
        self.greatest = np.maximum.reduceat(self.post_impact, self.starts[:-1]) if len(terms) else np.zeros(0)
        self._essential()

    def _essential(self) -> None:
        """Each unit's strongest terms. Its other terms sum to at most half the threshold, so a passage that reaches
        the threshold must hold strong terms of at least the other half."""
        n = len(self.terms)
        term = np.repeat(np.arange(n), np.diff(self.starts))
        order = np.lexsort((self.post_impact, self.post_unit))
        unit, impact = self.post_unit[order], self.post_impact[order]
        total = np.cumsum(impact)
        first = np.searchsorted(unit, np.arange(int(unit.max(initial=-1)) + 1))
        before = np.concatenate([[0.0], total])[first] if len(first) else np.zeros(0)
        strong = np.zeros(len(order), bool)
        strong[order] = total - before[unit] > self.retrieve / 2
        keep = np.flatnonzero(strong)
        self.strong_terms, inverse = np.unique(term[keep], return_inverse=True)
        self.strong_hashes = self.terms[self.strong_terms]
        self.strong_unit, self.strong_impact = self.post_unit[keep], self.post_impact[keep]
        self.strong_starts = np.searchsorted(inverse, np.arange(len(self.strong_terms) + 1))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.strong_hashes >> U64(48)).astype(np.int64)] = True

    def search(self, words: np.ndarray) -> dict[int, float]:
        """All units whose relative score for these words is at least the threshold, by block-max WAND."""
        distinct = np.unique(words)
        at = np.searchsorted(self.terms, distinct)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == distinct)]
        least = self.retrieve - 1e-9
        lists = [[int(self.post_unit[self.starts[t]]), t, int(self.starts[t]), int(self.starts[t + 1])] for t in at.tolist()]
        found = {}
        while lists:
            lists.sort()
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += self.greatest[x[1]]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            unit = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
                pivot += 1
            # block maxima of the lists up to the pivot, and where the first of those blocks ends
            best, ends = 0.0, []
            for x in lists[: pivot + 1]:
                p = self._seek(x, unit)
                a = x[2] if p >= x[3] else p - (p - int(self.starts[x[1]])) % BLOCK
                b = min(a + BLOCK, x[3])
                if p < x[3]:
                    best += float(self.post_impact[a:b].max())
                    ends.append(int(self.post_unit[b - 1]) + 1)
            if best < least:
                after = min([*ends, *(x[0] for x in lists[pivot + 1 : pivot + 2])], default=unit + 1)
                target = max(unit + 1, after)
            else:
                score = 0.0
                for x in lists[: pivot + 1]:
                    p = self._seek(x, unit)
                    if p < x[3] and self.post_unit[p] == unit:
                        score += float(self.post_impact[p])
                if score >= least:
                    found[unit] = score
                target = unit + 1
            rest = []
            for k, x in enumerate(lists):
                if k <= pivot:
                    x[2] = self._seek(x, target)
                    if x[2] >= x[3]:
                        continue
                    x[0] = int(self.post_unit[x[2]])
                rest.append(x)
            lists = rest
        return found

    def _seek(self, x: list, unit: int) -> int:
        return x[2] + int(np.searchsorted(self.post_unit[x[2] : x[3]], unit))

    def passages(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, first word) of every passage that may reach the threshold; h, at: words of several texts."""
        hit = np.flatnonzero(self.sieve[(h >> U64(48)).astype(np.int64)])
        t = np.searchsorted(self.strong_hashes, h[hit])
        ok = (t < len(self.strong_hashes)) & (self.strong_hashes[np.minimum(t, len(self.strong_hashes) - 1)] == h[hit])
        hit, t = hit[ok], t[ok]
        if not len(hit):
            return np.zeros((0, 2), np.int64)
        text = np.searchsorted(at, hit, "right") - 1
        window = (hit - at[text]) // STRIDE
        text, window, t = np.concatenate([text, text]), np.concatenate([window, window - 1]), np.concatenate([t, t])
        key = np.unique((text * (int(window.max()) + 1) + np.maximum(window, 0)) * len(self.strong_terms) + t)
        key, term = np.divmod(key, len(self.strong_terms))
        passage, where = np.unique(key, return_inverse=True)
        passage = np.stack(np.divmod(passage, int(window.max()) + 1), 1)
        n = np.diff(self.strong_starts)[term]
        index = np.repeat(self.strong_starts[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pair, back = np.unique(np.repeat(where, n) * (len(self.unit_item) + 1) + self.strong_unit[index], return_inverse=True)
        mass = np.bincount(back, self.strong_impact[index])
        reach = np.unique(pair[mass >= self.retrieve / 2 - 1e-9] // (len(self.unit_item) + 1))
        return np.stack([passage[reach, 0], passage[reach, 1] * STRIDE], 1)

    def verify(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the item's question and answer shingles in the words (an absent part: 1)."""
        shares = [float(np.isin(part, _shingles(words, k)).mean()) if k else 1.0 for k, part in self.parts[item]]
        return shares[0], shares[1]

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item id, best relative score, question share, answer share) of every verified match."""
        for first, group in grouped(texts):
            h, at = texts_word_hashes(group, PUNCTUATED)
            scores: dict[tuple[int, int], float] = {}
            for text, start in self.passages(h, at).tolist():
                a = int(at[text]) + start
                for unit, score in self.search(h[a : min(a + 2 * STRIDE, int(at[text + 1]))]).items():
                    key = (text, int(self.unit_item[unit]))
                    scores[key] = max(scores.get(key, 0.0), score)
            for (text, item), score in sorted(scores.items()):
                q, ans = self.verify(h[at[text] : at[text + 1]], item)
                if q >= OVERLAP and ans >= OVERLAP:
                    yield first + text, self.item_ids[item], score, q, ans


def _indexes(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in lots of at most INDEX_BYTES of text (a longer item is a lot of its own)."""
    lot, size = [], 0
    for r in items.select(F.col(quoted(item_col)).cast("long").alias("i"), F.col(quoted(text_col)).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        n = len(r["t"].encode("utf-8", "surrogatepass"))
        if lot and size + n > INDEX_BYTES:
            yield lot
            lot, size = [], 0
        lot.append((r["i"], r["t"]))
        size += n
    if lot:
        yield lot


def _terms(texts: DataFrame) -> DataFrame:
    """(term, units, words) of a column of item texts: each term's units, and under a null term all units and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [u for t in b.column(0).to_pylist() for u in _units(np.concatenate([_words(x) for x in split_item(t)]))]
            terms, df = np.unique(np.concatenate([np.unique(u) for u in units]) if units else np.zeros(0, U64), return_counts=True)
            columns = ([None, *terms.view(np.int64).tolist()], [len(units), *df.tolist()], [sum(map(len, units)), *[0] * len(terms)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "units", "words"])

    return texts.mapInArrow(run, "term long, units long, words long").groupBy("term").agg(F.sum("units").alias("units"), F.sum("words").alias("words"))


def _statistics(known: DataFrame, lot: list[tuple[int, str]]) -> tuple[int, float, np.ndarray, np.ndarray]:
    """What ``BlockMaxIndex`` takes of all items' terms for the terms of one lot."""
    units, words = known.filter("term IS NULL").select("units", "words").first()
    here = _terms(known.sparkSession.createDataFrame([(t,) for _, t in lot], "t string")).filter("term IS NOT NULL").select("term")
    found = known.join(here, "term").select("term", "units").toArrow()
    terms, df = found["term"].to_numpy().view(U64), found["units"].to_numpy()
    order = np.argsort(terms)
    return units, words / max(units, 1), terms[order], df[order]


def _held_indexes(items: DataFrame, item_col: str, text_col: str) -> Iterator[Broadcast]:
    """Each lot's index, built once on the driver and broadcast as arrays; a worker process unpacks it once."""
    spark = items.sparkSession
    item_col, text_col = named(items, item_col), named(items, text_col)
    texts = items.filter(F.col(quoted(item_col)).cast("long").isNotNull() & F.col(quoted(text_col)).isNotNull()).select(F.col(quoted(text_col)).alias("t"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    known = Workspace(spark, "leaks").table(_terms(texts), "terms") if size > INDEX_BYTES else None  # one lot has all statistics itself
    for lot in _indexes(items, item_col, text_col):
        yield spark.sparkContext.broadcast(BlockMaxIndex(lot, statistics=None if known is None else _statistics(known, lot)))


def _in_turn(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """Each lot's index, and whether it is the last."""
    before = None
    for held in _held_indexes(items, item_col, text_col):
        if before is not None:
            yield before, False
        before = held
    if before is not None:
        yield before, True


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each document text and item that it holds.

    ``score``: the best passage's BM25 score as a share of the score that the item's unit gives itself, at least
    ``RETRIEVE``. Overlaps: shares of the distinct 5-word shingles of the item's question and answer (its last sentence
    or line; of an answer below 17 words, narrower shingles) that occur in the whole document; both must be ``OVERLAP``
    or more. Words are runs of ASCII letters and digits or non-ASCII characters, A-Z in lower case. Null or wordless
    texts and items match nothing; rows that repeat an id are each searched, items that repeat one each count.
    Documents are scanned once an index and never shuffled; an index is built once and broadcast, bounded by
    ``INDEX_BYTES``, and statistics such as idf are those of all items, however many indexes they make. Of several, what
    one finds is written before the next is handed out, so a task holds one index.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "found")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(quoted(named(docs, id_col))).cast("long").alias("doc_id"), F.col(quoted(named(docs, text_col))).cast("string").alias("text"))
    out = None
    for i, (held, last) in enumerate(_in_turn(items, item_col, item_text)):

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, found = b.column(0).to_pylist(), list(held.value.matches(b.column(1).to_pylist()))
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        part = rows.mapInArrow(lean(run), schema)
        if not last:
            part = ws.table(part, f"lot{i}")
            held.unpersist()
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (see ``find_leaks``); each row goes by its own text,
    whatever its id. Rows are left out in the task that reads them: nothing is shuffled. Of several indexes, the rows that
    one leaves are written before the next is handed out, so a task holds one index."""
    at = docs.columns.index(named(docs, text_col))
    text = docs.schema.fields[at].dataType.simpleString()
    if text != "string":
        raise ValueError(f"{text_col} is {text}, not string")
    out, ws = docs, Workspace(docs.sparkSession, "left")
    for i, (held, last) in enumerate(_in_turn(items, item_col, item_text)):

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in held.value.matches(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), docs.schema)
        if not last:
            out = ws.table(out, f"lot{i}")
            held.unpersist()
            if i:
                ws.drop(f"lot{i - 1}")
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
