"""Ranked lexical search by sort-based accumulation.

One pass over the texts writes, for each document, its length and the query terms that it holds with their counts.
A second pass over these postings lists (item, document, impact) for all items that hold a term, a bounded range of
documents at a time, sorts the packed keys by radix and sums equal ones. Only rows that can be among an item's best
leave the task; they are range-partitioned by item and a part of the hash, and a heap per item selects.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, parts, release, remove, written

#: (item, term) pairs of the items that a pass serves, whose index every task holds (some 40 bytes each); more items take more passes.
PAIRS = 200_000
#: (item, document, impact) rows that a task sorts at a time, and parts of an item's candidates.
TOGETHER, SALTS = 2_000_000, 16

_DIGIT_OR_LETTER = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Bytes that end terms become spaces; A-Z are lowered; all bytes of other characters belong to terms.
_FOLD = bytes(ord(chr(i).lower()) if i < 128 and i in _DIGIT_OR_LETTER else (i if i >= 128 else 32) for i in range(256))


def terms(text: bytes) -> list[bytes]:
    """The runs of ASCII letters, digits and other characters than ASCII in a UTF-8 text, with A-Z lowered."""
    return text.translate(_FOLD).split()


def _slices(items: DataFrame, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items (number, distinct terms) in slices of some ``most`` pairs; the driver holds one slice at a time."""
    some: dict[int, set[bytes]] = {}
    n = 0
    for r in items.orderBy("item").toLocalIterator():
        new = set(terms(bytes(r["text"] or b"")))
        if n and n + len(new) > most and r["item"] not in some:
            yield [(k, sorted(v)) for k, v in some.items()]
            some, n = {}, 0
        some.setdefault(r["item"], set()).update(new)
        n += len(new)
    if some:
        yield [(k, sorted(v)) for k, v in some.items()]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every row that has terms: how many, and which of the vocabulary with their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = vocabulary.get, len(vocabulary) + 1
        for b in batches:
            n, ids = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = terms(t or b"")
                n.append(len(words))
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                ids.append(np.unique(at[at >= 0] + size * (len(n) - 1), return_counts=True))
            n = np.array(n, dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x, _ in ids]))).astype(np.int32)
            flat, counts = (np.concatenate([x[i] for x in ids]) for i in (0, 1)) if ids else (np.empty(0, np.int64), np.empty(0, np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (flat % size, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))
            release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).mapInArrow(each, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def by_radix(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned keys, 16 bits at a time (which numpy's stable sort does by counting)."""
    top = int(keys.max()) if len(keys) else 0
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    shift = 16
    while top >> shift:
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


class _Best:
    """The ``top`` best (score, id) of each item: a heap whose root is the worst that is kept."""

    def __init__(self, top: int):
        self.top, self.heaps = top, {}

    @staticmethod
    def _order(score: int, doc: int | None) -> tuple:
        return (score, doc is not None, -doc if doc is not None else 0)  # null ids come last

    def add(self, item: int, score: int, doc: int | None) -> None:
        heap, row = self.heaps.setdefault(item, []), (self._order(score, doc), doc)
        if len(heap) < self.top:
            heapq.heappush(heap, row)
        elif row[0] > heap[0][0]:
            heapq.heapreplace(heap, row)

    def least(self, item: int) -> int:
        """No lower score can be among the item's best."""
        heap = self.heaps.get(item, ())
        return heap[0][0][0] if len(heap) == self.top else 1

    def rows(self) -> tuple[list, list, list]:
        got = [(item, order[0], doc) for item, heap in self.heaps.items() for order, doc in heap]
        return tuple(map(list, zip(*got))) if got else ([], [], [])


def _accumulate(items_of: tuple[np.ndarray, np.ndarray], weights: np.ndarray, numbers: np.ndarray, n_docs: int, n_words: int, top: int, schema: pa.Schema):
    """Over postings: the task's best documents of each item. items_of: ends and item places by term."""
    ends, places = items_of
    per_term = np.diff(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(top)
        least = np.ones(len(numbers), dtype=np.int64)
        for b in batches:
            ids, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            lists = b.column(2)
            # a filtered or sliced batch keeps its whole values, so offsets are taken from the first row's
            first, until = np.asarray(lists.offsets)[0], np.asarray(lists.offsets)
            term = lists.flatten().to_numpy()
            tf = b.column(3).flatten().to_numpy().astype(np.int64)
            many = np.diff(until - first)
            doc = np.repeat(np.arange(len(ids)), many)
            m = 10 + (90 * n * n_docs) // n_words
            part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            cost = np.concatenate(([0], np.cumsum(per_term[term])))
            row_cost = cost[until - first]
            i = 0
            while i < len(ids):  # documents of some TOGETHER rows, one at least
                j = max(i + 1, int(np.searchsorted(row_cost, row_cost[i] + TOGETHER, side="right")) - 1)
                a, z = int(until[i] - first), int(until[j] - first)
                t, c = term[a:z], per_term[term[a:z]]
                place = np.repeat(ends[t] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(int(c.sum()))
                impact = np.repeat(weights[t] * part[a:z], c)
                keys = places[place].astype(np.uint64) * np.uint64(j - i) + np.repeat(doc[a:z] - i, c).astype(np.uint64)
                order = by_radix(keys)
                keys = keys[order]
                heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else np.empty(0, np.int64)
                score = np.add.reduceat(impact[order], heads) if len(heads) else np.empty(0, np.int64)
                item, of = (keys[heads] // np.uint64(j - i)).astype(np.int64), (keys[heads] % np.uint64(j - i)).astype(np.int64) + i
                able = np.flatnonzero(score >= least[item])
                # an item's candidates come best first, so that the heap's bound rises at once
                able = able[np.lexsort((-score[able], item[able]))]
                for x, s, d in zip(item[able].tolist(), score[able].tolist(), of[able].tolist()):
                    if s >= least[x]:
                        best.add(x, s, ids[d])
                        least[x] = best.least(x)
                i = j
        item, score, doc = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[np.array(item, dtype=np.int64)]), pa.array(score, pa.int64()), pa.array(doc, schema.field("doc_id").type)], schema=schema)
        release()

    return run


def _select(top: int, schema: pa.Schema):
    """Over rows (item, score, doc_id): the best of each item, by a heap each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(top)
        for b in batches:
            for x, s, d in zip(*(b.column(c).to_pylist() for c in ("item", "score", "doc_id"))):
                best.add(x, s, d)
        item, score, doc = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, schema.field("doc_id").type)], schema=schema)

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, in whole numbers.

    N documents have terms, L terms in all; a term that df of them hold weighs w = floor(1000 ln((2N+2)/(2df+1)));
    a document of n terms has m = 10 + 90 n N div L; an item's score is the sum over its distinct terms of
    w (10^9 tf div (1000 tf + 8 m)). Equal scores go by ascending doc_id, null ids last; rank counts from 1.

    Every row of docs is a document, repeated ones too. Null and empty texts have no terms and are in no count.
    Rows of items with one id (also null) are one item with the terms of all; items without terms give nothing;
    empty tables give an empty result; other columns are ignored. Items go in slices of ``pairs`` (item, term)
    pairs, so what a task holds is bounded; statistics always cover all documents.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "item long, score long, doc_id long"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    numbered, at_items = written(items.select(F.col(item).alias("item_id"), F.col(item_text).cast("binary").alias("text")).withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id")), "items")
    out = None
    for some in _slices(numbered, pairs):
        words = sorted({t for _, ts in some for t in ts})
        if not words:
            continue
        vocabulary = {t: i for i, t in enumerate(words)}
        postings, at_postings = written(_postings(rows, vocabulary), "postings")
        total = postings.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row a query term at the most
        if total["n"] and held:
            df = np.zeros(len(words), dtype=np.int64)
            df[[r["term"] for r in held]] = [r["count"] for r in held]
            weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
            who = [[] for _ in words]
            for place, (_, ts) in enumerate(some):
                for t in ts:
                    if weights[vocabulary[t]] > 0:
                        who[vocabulary[t]].append(place)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in who])))
            places = np.array([p for x in who for p in x], dtype=np.int64)
            run = _accumulate((ends, places), weights, np.array([k for k, _ in some], dtype=np.int64), total["n"], total["l"], top, schema)
            # written first: a range partitioning reads its input twice
            best, at_best = written(postings.mapInArrow(run, kind), "candidates")
            best = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
            best = best.repartitionByRange(parts(docs), "item", "part").select("item", "score", "doc_id").mapInArrow(_select(top, schema), kind)
            best, _ = written(best.repartitionByRange(parts(docs), "item").mapInArrow(_select(top, schema), kind), "best")
            remove(spark, at_best)
            out = best if out is None else out.unionByName(best)
        remove(spark, at_postings)
    if out is None:
        out = spark.createDataFrame([], kind)
    from pyspark.sql import Window

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # top rows an item
    names = numbered.select("item", "item_id").dropDuplicates(["item"])
    return out.withColumn("rank", F.row_number().over(order)).join(names, "item").select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB's SQL: every term of every document and item, joined and summed.
ORACLE_SQL = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS d FROM documents),
ask AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
docs AS (SELECT d, doc_id, len(w) AS n, w FROM fold WHERE len(w) > 0),
total AS (SELECT count(*) AS nn, sum(n) AS ll FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM ask) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, nn),
score AS (SELECT item_id, d, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * CAST(10 + (90 * n * nn) // ll AS BIGINT)))) AS BIGINT) AS score FROM tf JOIN ask USING (term) JOIN weight USING (term) JOIN docs USING (d), total GROUP BY item_id, d),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM score JOIN docs USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
