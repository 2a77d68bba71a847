import random

from sextant.operators.evaluation import REJECTED, threshold_sweep


def plain(golden, retrieved, steps, k, width, digits):
    out = []
    share = lambda n, of: round(n / of, 4) if of else None
    for i in range(steps):
        t = round(i * width, digits)
        hit = right = wrong = 0
        for q, category, answerable, register, section in golden:
            kept = [r for r in sorted((r for r in retrieved if r[0] == q), key=lambda r: r[1]) if r[4] is not None and r[4] >= t]
            hit += answerable and any((r[2], r[3]) == (register, section) for r in kept[:k])
            right += category in REJECTED and not kept
            wrong += answerable and not kept
        n, m = sum(g[2] for g in golden), sum(g[1] in REJECTED for g in golden)
        a, b = share(hit, n) or 0.0, share(right, m) or 0.0
        out.append((t, a, b, share(wrong, n), round((a + b) / 2, 4)))
    return out


def same(got, want):
    return len(got) == len(want) and all((x is None) == (y is None) and (x is None or abs(x - y) < 1.5e-4) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_a_thousand_thresholds_against_brute_force(spark):
    rng = random.Random(9)
    golden = [(q, rng.choice([*REJECTED, "con_respuesta"]), rng.random() < 0.7, str(rng.randrange(3)), rng.choice(["1", "2", None])) for q in range(60)]
    retrieved = []
    for q, *_ in golden[5:]:
        # Scores needn't fall with the rank, and many lie on a threshold.
        retrieved += [(q, rank, str(rng.randrange(3)), rng.choice(["1", "2", None]), rng.choice([round(rng.random(), 3), rng.random(), 0.0, 1.0, 0.15])) for rank in range(1, rng.randint(2, 14))]
    g = spark.createDataFrame(golden, "question_id int, category string, answerable boolean, expected_register string, expected_section string")
    r = spark.createDataFrame(retrieved, "question_id int, rank int, register string, section string, score double")
    for steps, k, width, digits in ((1000, 5, 0.001, 3), (19, 3, 0.05, 2), (1000, 1, 0.001, 3)):
        got = [tuple(x) for x in threshold_sweep(g, r, steps, k, width, digits).orderBy("threshold").collect()]
        assert same(got, plain(golden, retrieved, steps, k, width, digits))
    nothing = [tuple(x) for x in threshold_sweep(g, r.limit(0), 5).orderBy("threshold").collect()]
    assert same(nothing, plain(golden, [], 5, 5, 0.05, 2))
    assert threshold_sweep(g.limit(0), r).count() == 0
