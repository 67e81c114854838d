import math
import random
from collections import Counter

from folioflux.operators.lines import UNIT, directions, hough_lines, hough_votes, skew


def brute(points, angles, width, least):
    votes = Counter()
    for x, y in points:
        for k, (c, s) in enumerate(directions(angles)):
            votes[k, (x * c + y * s) // (width * UNIT)] += 1

    def around(a, d):
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if (i, j) != (0, 0):
                    b = a + i
                    # who sends to (a, d): the bin one step away, seen from its own side of the wrap
                    yield ((b % angles), d + j if 0 <= b < angles else -d - 1 + j)

    key = lambda b: (votes[b], -b[0], -b[1])
    return {(a, d, n) for (a, d), n in votes.items() if n >= least and all(key((a, d)) > key(b) for b in around(a, d) if b in votes)}


def test_lines_against_brute_force_and_their_skew(spark):
    rng = random.Random(3)
    pictures = {"level": 0.0, "tilted": 4.0, "empty": None}
    rows, want = [(None, 1, "level"), (5, None, "level")], {}
    for name, degrees in pictures.items():
        points = [(rng.randrange(-50, 400), rng.randrange(-50, 300)) for _ in range(60)]
        for base in (40, 120, 200) if degrees is not None else ():
            points += [(x, round(base + math.tan(math.radians(degrees)) * x)) for x in range(0, 400, 3)]
        points += points[:5]
        rows += [(*p, name) for p in points]
        want[name] = brute(points, 90, 2, 30)
    df = spark.createDataFrame(rows, "x long, y long, name string").repartition(3)
    lines = hough_lines(hough_votes(df, ["name"], "x", "y", 90, 2), ["name"], 30, 90)
    got: dict = {n: set() for n in pictures}
    for r in lines.collect():
        got[r.name].add((r.angle, r.distance, r.votes))
    assert got == want and len(want["level"]) >= 3 and not want["empty"]
    leans = {r.name: r.skew for r in skew(lines, ["name"], 90).collect()}
    assert abs(leans["level"]) < 1 and abs(leans["tilted"] - 4.0) <= 2.0 and "empty" not in leans
    assert hough_lines(hough_votes(df.limit(0), ["name"], "x", "y"), ["name"], 1).count() == 0
