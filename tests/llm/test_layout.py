"""Results depend on rows alone: not on partitions, and not on the package being there on executors."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, awkward, words

from driftmark.llm import clustering, language_id, packing

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("parts", [5, 17])
def test_bins_and_languages_over_other_partitions(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(40)).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")).limit(60))

    def found(n):
        rows = docs.repartition(n, F.rand(n))
        packed = packing.pack(packing.document_items(rows), group_pieces=300).collect()
        named = language_id.identify(rows, language_id.fit(rows, 60)).collect()
        return sorted(map(tuple, packed), key=str), sorted(map(tuple, named), key=str)

    assert found(3) == found(parts)  # bit by bit


def test_copies_of_a_row_are_spread(spark):
    one = spark.createDataFrame([(None, 700, "a", 7)], "item long, size long, source string, cluster long")
    rows = one.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(25_000)))).drop("x")
    packed = packing.pack(rows, group_pieces=1_000)
    assert packed.count() == 25_000 and packed.select("bin").distinct().count() == 25_000  # copies never share a bin
    groups = packed.groupBy(F.shiftright("bin", 24).alias("g")).count().collect()
    assert len(groups) == 25 and max(r["count"] for r in groups) < 1_300


def brute_names(model, texts):
    """Both levels anew, one text and one machine at a time."""
    out = []
    for t in texts:
        x = language_id.features(t)
        if x is None:
            out.append(("und", 0.0))
            continue

        def share(choice, x=x):
            logs = dict.fromkeys(choice.names, 0.0)
            for m in choice.machines:
                margin = m.slope * (float(np.dot(x, m.weights[:-1])) + float(m.weights[-1])) + m.shift
                logs[m.a] -= float(np.log1p(np.exp(-margin)))
                logs[m.b] -= float(np.log1p(np.exp(margin)))
            total = sum(np.exp(v) for v in logs.values())
            return {k: float(np.exp(v) / total) for k, v in logs.items()}

        families = share(model.families)
        family = max(families, key=families.get)
        inner = share(model.members[family])
        best = max(inner, key=inner.get)
        out.append((best, families[family] * inner[best]))
    return out


def test_languages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, 40)
    rows = docs.orderBy("doc_id").limit(60).unionByName(spark.createDataFrame(awkward()[-12:], DOCS)).collect()
    got = language_id.identify(spark.createDataFrame([(k, r["text"]) for k, r in enumerate(rows)], "doc_id long, text string").repartition(4), model).orderBy("doc_id").collect()
    for r, (name, score) in zip(got, brute_names(model, [r["text"] for r in rows]), strict=True):
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score, abs=1e-4)


def test_many_language_codes_stay_bounded(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, 20), f"x{k}", "a", 0) for k in range(300)] + [(1000 + k, words(rng, 20) + f" {'aeiou'[k % 2] * 9}", "en" if k % 2 else "fr", "a", 0) for k in range(80)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), languages=5)
    assert "en" in model.members["germanic"].names and sum(len(c.names) for c in model.members.values()) <= 5


def test_clusters_over_other_partitions(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = [sorted(map(tuple, clustering.cluster(vectors.repartition(n, F.rand(n))).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 500


SCRIPT = """
import sys, tempfile
from pyspark.sql import SparkSession
folder = tempfile.mkdtemp()
builder = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
spark = builder.config("spark.checkpoint.dir", folder).config("spark.local.dir", folder).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, {root!r})  # only the driver has the package
import __spark_entry__
known = __spark_entry__.queries()
for name in {names!r}:
    print(name, known[name](spark, "/root/testdata/sf0.001").count())
def there(_):
    import driftmark
    return driftmark.__name__
try:
    spark.sparkContext.parallelize([1], 1).map(there).collect()
    print("workers have the package")
except Exception:
    print("done")
"""


def test_workers_need_no_package(tmp_path):
    names = ["op1_best_fit_packing", "op3_language_id", "op6_near_dedup", "op11_decontamination", "op12_clustering", "op13_spelling"]
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), names=names)], cwd=tmp_path, capture_output=True, text=True, timeout=400, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert run.stdout.split("\n")[-2] == "done", run.stdout + run.stderr[-2_000:]
    assert all(any(line.startswith(n) for line in run.stdout.split("\n")) for n in names)
