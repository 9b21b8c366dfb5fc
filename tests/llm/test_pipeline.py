"""The pipeline's stages, each against what it should do with its own input."""

from collections import Counter

import corpus_pipeline as P
from kinframe.llm import toxicity
from kinframe.llm.shared import written

from .test_near_copies import groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "suffix_array", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in P.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        docs, _ = written(stage(spark, docs, SF), name)
        at[name] = rows, [tuple(r) for r in docs.collect()], docs
        if name != "sentencepiece":
            assert docs.columns == columns
    before, after, _ = at["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), model).where("predicted = 1").collect()}
    assert set(before) - set(after) == {r for r in before if r[0] in rejected}
    before, after, _ = at["simhash"]
    want, _ = groups([(r[0], r[1]) for r in before])  # five words, similarity 0.8, all pairs tried
    assert set(after) == {r for r in before if want[r[0]] == r[0]}
    before, after, _ = at["suffix_array"]
    assert [r[0] for r in sorted(before)] == [r[0] for r in sorted(after)]
    n = P.REPEAT_BYTES
    count = Counter(r[1].encode()[i : i + n] for r in before for i in range(len(r[1].encode()) - n + 1))
    left = {r[0]: r for r in after}
    for r in before:
        t = r[1].encode()
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        text = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        assert left[r[0]][1] == text and left[r[0]][4] == (len(text) if any(gone) else r[4])
    before, after, _ = at["decontamination"]
    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for r in before:
        w = words(r[1])
        spots = {}
        for i, x in enumerate(w):
            spots.setdefault(x, []).append(i)
        for it in items:
            places = Counter(i - j for j, x in enumerate(it) for i in spots.get(x, ()))
            if len(it) >= 5 and places and max(places.values()) >= 0.8 * len(it):
                bad.add(r[0])
    assert {r[0] for r in before} - {r[0] for r in after} == bad
    before, after, last = at["sentencepiece"]
    assert {r[0] for r in before} == {r[0] for r in after} and last.where("NOT decoded").count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and "doc_id" in out.columns


def test_entry_lists_all():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
