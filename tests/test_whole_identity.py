import random
from difflib import SequenceMatcher

from arenaflow.operators import identity


def test_resolve_equals_all_pairs(spark):
    rng = random.Random(6)
    known = ["abcdefgh"] + ["".join(rng.choices("abcdeft", k=rng.randint(4, 12))) for _ in range(40)]
    raw = ["xabcdefghy"]
    for k in known:
        at = rng.randrange(len(k))
        raw += ["x" + k + "y", k[1:] + "q", k[:at] + "z" + k[at:], k[::-1]]
    raw = sorted({r for r in raw if len(r) >= 4} - set(known))
    got = {r.raw_name: (r.how, r.score) for r in identity.resolve(
        spark.createDataFrame([(r, None) for r in raw], "raw_name string, login string"),
        spark.createDataFrame([(k, k) for k in sorted(set(known))], "canonical_id string, variant string")).collect()}
    assert got["xabcdefghy"][0] == "review"
    for r in raw:
        best = max(SequenceMatcher(None, r, k).ratio() for k in known)
        assert got[r][0] == ("fuzzy" if best >= 0.92 else "review" if best >= 0.78 else "new"), (r, best, got[r])
        assert best < 0.78 or abs(got[r][1] - best) < 1e-9
