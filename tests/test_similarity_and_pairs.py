import math
import random

from pyspark.sql import functions as F

from tallyweave.functions import similarity as S
from tallyweave.functions.text import prepared
from tallyweave.operators import pairs


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def strings(n, seed=1):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice("abc d") for _ in range(rng.randrange(0, 14)))
    return [(make(), make()) for _ in range(n)]


def test_ratio_and_partial():
    for a, b in strings(400):
        assert S.common_subsequence(a, b) == slow_lcs(a, b)
    assert S.ratio("kitten", "sitting") == 8 / 13 and S.ratio("", "") == 1.0
    for a, b in strings(200, 2):
        if a and b and len(a) < len(b):
            spans = [b[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1) if j - i == len(a) or (j - i < len(a) and (i == 0 or j == len(b)))]
            assert math.isclose(S.partial_ratio(a, b), max(S.ratio(a, x) for x in spans))
    assert S.partial_ratio("abc", "xxabcxx") == 1.0


def test_token_set_and_jaro_winkler():
    assert S.token_set_ratio("new york mets", "mets york") == 1.0
    assert S.token_set_ratio("", "a") == 0.0
    assert round(S.jaro_winkler("martha", "marhta"), 6) == 0.961111
    assert round(S.jaro_winkler("dixon", "dicksonx"), 6) == 0.813333
    assert S.jaro_winkler("abc", "xyz") == 0.0


def test_native_ratio(spark):
    rows = spark.createDataFrame(strings(60, 3), "a string, b string")
    for r in rows.select("a", "b", S.ratio_native(F.col("a"), F.col("b")).alias("r")).collect():
        assert math.isclose(r["r"], S.ratio(r["a"], r["b"]), abs_tol=1e-12)


def features(spark, left, right):
    make = lambda r, n: prepared(spark.createDataFrame([(n, *r)], "row_id long, entity_id string, business_name string, business_address string, country string"))
    rows = pairs.features(spark.createDataFrame([(1, 2)], "query_id long, row_id long"), make(left, 1), make(right, 2)).collect()
    return rows[0].asDict()


def test_features_are_finite_and_ignore_ids(spark):
    one = features(spark, ("S1-1", "दिल्ली कैफे", "23 Rue du Centre", "France"), ("S2-200", "दिल्ली कैफे", "23 Rue du Centre", "France"))
    two = features(spark, ("S1-999", "दिल्ली कैफे", "23 Rue du Centre", "France"), ("S3-7", "दिल्ली कैफे", "23 Rue du Centre", "France"))
    assert one == two and len(pairs.FEATURES) == 47 and all(math.isfinite(one[f]) for f in pairs.FEATURES)
    assert one["name_ratio"] == one["address_equal"] == one["house_equal"] == 1.0


def test_missing_address_is_not_an_exact_match(spark):
    got = features(spark, ("a", "Acme", "", "x"), ("b", "Acme", "", "y"))
    assert got["address_equal"] == 0 and got["left_address_missing"] == got["right_address_missing"] == 1 and got["country_equal"] == 0


def test_windows_and_matches_against_plain_loops():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
        return row[-1]

    def partial(a, b):
        if not a or not b:
            return 1.0 if a == b else 0.0
        best = 0.0
        for s, l in [(a, b)] * (len(a) <= len(b)) + [(b, a)] * (len(b) <= len(a)):
            spans = [(k, k + len(s)) for k in range(len(l) - len(s) + 1)] + [(0, e) for e in range(1, len(s))] + [(k, len(l)) for k in range(len(l) - len(s) + 1, len(l))]
            best = max([best] + [2 * lcs(s, l[x:y]) / (len(s) + y - x) for x, y in spans])
        return best

    def jaro(a, b):
        if not a or not b:
            return 1.0 if a == b else 0.0
        reach, taken, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
        for i, c in enumerate(a):
            at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
            if at is not None:
                taken.add(at)
                hits.append(c)
        if not hits:
            return 0.0
        m = len(hits)
        swapped = sum(x != b[j] for x, j in zip(hits, sorted(taken))) // 2
        out = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
        same = next((n for n, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        return out + 0.1 * same * (1 - out) if out > 0.7 else out

    rng = random.Random(8)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 13))) for _ in range(2))
        assert abs(S.partial_ratio(a, b) - partial(a, b)) < 1e-12, (a, b)
        assert abs(S.jaro_winkler(a, b) - jaro(a, b)) < 1e-12, (a, b)
