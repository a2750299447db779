"""Every stage of the pipeline on nulls, empty, long and repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

corpus = pytest.importorskip("corpus_pipeline")

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ITEM = "one two three four five six seven"
SECRET = "call with password=hunter2hunter2 now please"
ROWS = [
    (0, "plain words of a text that says something here", "en", "a", 46), (0, "plain words of a text that says something here", "en", "a", 46), (1, None, None, None, None), (2, "", "en", "a", 0),
    (None, "no id but words enough to be a text of its own", None, "b", 1), (3, f"before it {ITEM} and after it", "en", "b", 5), (4, SECRET, "de", "c", 44), (5, LONG, "en", "c", len(LONG)),
    (6, LONG + " end", "fr", None, 7), (7, "\t\n \r", "en", "a", 4), (8, ITEM, "en", "a", 33),
]
EXTRA = ["key", "score", "v", "rid", "salt", "item_id", "item", "_spans", "label"]


def key(x):
    return tuple((v is None, str(v)) for v in x)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", *(F.lit(i).alias(c) for i, c in enumerate(EXTRA)))
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def run(spark, tables, name, docs=None):
    folder, given = tables
    return dict(corpus.STAGES)[name](spark, given if docs is None else docs, folder)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


@pytest.mark.parametrize("name", [n for n, _ in corpus.STAGES])
def test_empty(spark, tables, name):
    out = run(spark, tables, name, tables[1].limit(0))
    assert out.collect() == []
    if name != "packing":
        assert out.columns == tables[1].columns


def test_quality_keeps_all_where_all_labels_are_good(spark, tables):
    out = run(spark, tables, "quality classifier")
    assert out.columns == tables[1].columns
    assert sorted(map(key, out.collect())) == sorted(map(key, tables[1].collect()))


def test_near_dedup(spark, tables):
    out = run(spark, tables, "near-dedup")
    assert out.columns == tables[1].columns
    # The repeated row and the longer copy go; rows without an id, and texts without words, stay.
    assert ids(out) == [0, 1, 2, 3, 4, 5, 7, 8, None]


def test_decontamination(spark, tables):
    out = run(spark, tables, "decontamination")
    assert out.columns == tables[1].columns
    assert ids(out) == [0, 0, 1, 2, 4, 5, 6, 7, None]


def test_secrets(spark, tables):
    out = run(spark, tables, "secret scans")
    assert out.columns == tables[1].columns
    changed = {r["doc_id"]: r for r in out.collect() if r["doc_id"] == 4}
    assert changed[4]["text"] == "call with [secret] now please" and changed[4]["n_chars"] == len(changed[4]["text"])
    rest = [r for r in out.collect() if r["doc_id"] != 4]
    assert sorted(map(key, rest)) == sorted(map(key, tables[1].where("doc_id is null or doc_id != 4").collect()))


def test_packing(spark, tables):
    pieces = run(spark, tables, "packing")
    assert pieces.where("start = 0").count() == len(ROWS)
    per_text = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert all(r["n"] % r["doc_tokens"] == 0 for r in per_text)


def test_whole_run(spark, tables):
    out = corpus.run(spark, tables[0])
    assert set(ids(out.where("start = 0"))) == {0, 1, 2, 4, 5, 7, None}


def test_stages_by_brute_force(spark, sf):
    """Near-dedup, decontamination and secrets of the small corpus against sets of shingles and the plain patterns."""
    import re

    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    stages = dict(corpus.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    once = stages["near-dedup"](spark, docs, sf)
    assert ids(once) == [i for i in order if root(i) == i]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, docs, sf)
    assert ids(clean) == [i for i in order if not any(x and 100 * len(sets[i] & x) >= 80 * len(x) for x in items)]
    # The smallest corpus has no secret that looks live.
    larger = spark.read.parquet(f"{sf}/documents.parquet".replace("sf0.001", "sf0.01"))
    texts = {r["doc_id"]: r["text"] for r in larger.collect()}
    masked = {r["doc_id"]: r["text"] for r in stages["secret scans"](spark, larger, sf).collect()}
    assert set(masked) == set(texts) and any(masked[i] != texts[i] for i in texts)
    for i, t in masked.items():
        if t != texts[i]:
            at = 0
            for k, piece in enumerate(t.split("[secret]")):
                found = texts[i].find(piece, at + 6 if k else 0)
                assert found >= 0 and (k or not found)
                at = found + len(piece)
            assert at == len(texts[i])
