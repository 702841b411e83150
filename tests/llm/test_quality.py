import math
import re
from collections import Counter
from fractions import Fraction

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskframe.llm import quality
from llm_helpers import docs, odd_texts, real_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x0b\x1c", max_size=80))
def test_counts(text):
    assert quality.counts(text)[:5] == brute(text)


def test_counts_of_rows(spark, sf):
    texts = odd_texts() + real_texts(spark, sf, 60) + ["the " * 20_000]
    got = {r["doc_id"]: r for r in quality.measures(docs(spark, texts)).collect()}
    assert [tuple(got[i][c] for c in quality.COUNTS[:5]) for i in range(len(texts))] == [brute(t) for t in texts]


def exact_cdf(k, n, p):
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_binomial_bound_is_exact():
    for n, k, p in ((10, 0, Fraction(1, 10)), (50, 7, Fraction(1, 5)), (300, 2, Fraction(1, 50)), (5, 5, Fraction(1, 2))):
        assert math.isclose(quality.binomial_cdf(k, n, float(p)), exact_cdf(k, n, p), rel_tol=1e-9)


def test_binomial_bound_of_many_documents():
    """Against a normal approximation with the term for skewness, in no time and no memory."""
    n, p = 10**9, 0.003
    mean, sd = n * p, math.sqrt(n * p * (1 - p))
    for z in (-4, -1, 0, 1, 4):
        k = int(mean + z * sd)
        x = (k + 0.5 - mean) / sd
        skew = (1 - 2 * p) / sd * (x * x - 1) / 6 * math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        assert math.isclose(quality.binomial_cdf(k, n, p), 0.5 * math.erfc(-x / math.sqrt(2)) - skew, rel_tol=1e-4)
    assert quality.binomial_cdf(0, n, p) == 0 and quality.binomial_cdf(n // 2, n, p) == 1


def test_two_thousand_strata(spark):
    texts = [" ".join(f"w{j}" for j in range(60))] * 4000 + ["a" * 30 + " b" * 80]
    df = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2000 > 0, F.concat(F.lit("s"), F.col("doc_id") % 2000)))
    measured = quality.measures(df)
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    cutoffs = quality.calibrate(measured, labels)
    assert cutoffs.count() == 2000 and cutoffs.filter("cut_stratum is null").count() == 1
    rows = quality.judge(measured, cutoffs).collect()
    assert len(rows) == 4001 and sum(r["kept"] for r in rows) == 4000


def test_cutoffs_are_the_lowest_that_pass_the_test():
    grids = {"r": [1.0, 2.0, 3.0]}
    above = {("en", "r", 0): 40, ("en", "r", 1): 1, ("few", "r", 0): 0}
    got = quality.choose_cutoffs(above, {"en": 2000, "few": 5}, grids, 0.02, 0.05)
    assert got == {"en": {"r": 2.0}, "few": {"r": math.inf}}
    assert exact_cdf(1, 2000, Fraction(2, 100)) <= 0.05 / 2 < exact_cdf(40, 2000, Fraction(2, 100))


def test_verdicts(spark):
    """Junk goes, good documents stay, a stratum without labels keeps all."""
    good = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(3000)]
    junk = [" ".join(f"W{i}X{j}!!" for j in range(60)) for i in range(40)]
    texts = good + junk + ["short", None, "same same " * 60]
    df = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") == 3001, "zz").otherwise(F.col("lang"))).withColumn("stratum", F.lit(9))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).unionByName(
        spark.createDataFrame([(0, None), (1, 1), (3000, 0)], "doc_id long, quality int"))
    rows = {r["doc_id"]: r for r in quality.score(df, labels).collect()}
    assert all(rows[i]["kept"] for i in range(3000))
    assert not any(rows[i]["kept"] for i in range(3000, 3040) if i != 3001)
    assert rows[3001]["kept"] and "upper_share" in rows[3002]["rejected_by"]
    assert [rows[i]["base_failed"] for i in (3040, 3041, 3042)] == [True] * 3 and not rows[3042]["kept"]


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs(spark, ["x"]).filter("false"), labels).count() == 0
    assert {r["kept"] for r in quality.score(docs(spark, ["w " * 3, " ".join(map(str, range(99)))]), labels).collect()} == {False, True}
