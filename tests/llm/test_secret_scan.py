import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa

from folioflux.llm import secret_scan as S
from folioflux.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, id string, secrets int, spans string"


def forge(prefix, body):
    crc, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, k = divmod(crc, 62)
        out = S.BASE62.decode()[k] + out
    return f"{prefix}_{body}{out}"


def bech32(prefix, data):
    """A bech32 string of 5-bit values, by the polynomial's definition."""

    def mod(values):
        check = 1
        for v in values:
            top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
            for k in range(5):
                check ^= (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)[k] * (top >> k & 1)
        return check

    start = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    rest = mod([*start, *data, *[0] * 6]) ^ 1
    return prefix + "1" + "".join("qpzry9x8gf2tvdw0s3jn54khce6mua7l"[v] for v in [*data, *(rest >> 5 * (5 - k) & 31 for k in range(6))])


def brute(text):
    """All spans by whole-text searches, code points throughout."""
    text, out = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.ASCII):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    for k, pattern in ((3, r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), (4, r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])")):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if forge(m[0].split("_")[0], m[0][4:34]) == m[0]]
    for m in re.finditer(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![A-Za-z0-9_])", text):
        data = ["qpzry9x8gf2tvdw0s3jn54khce6mua7l".index(c) for c in m[0][16:].lower()]
        out += [(m.start(), 5, m.end())] if bech32("age-secret-key-", data[:52]).upper() == m[0] else []
    return [(s, e, S.KINDS[k]) for s, k, e in sorted(out)]


def cases():
    rng = random.Random(11)
    good, npm = forge("ghp", "aB3" * 10), forge("npm", "Zz9" * 10)
    age = bech32("age-secret-key-", [rng.randrange(32) for _ in range(52)]).upper()
    texts = [None, "", " ", "token", "token=", "TOKEN = 'abc12'", "Api_Key:\"abcdef\"", "apikey=abcdef", "toKen=token=abcdef", "token=token: abcdefg", "secretoken=abcdef", "token" + " " * 5000 + "= x",
             "password password=passwd=123", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAKIA" + "Z9" * 10, "akia" + "A" * 16, "é" * 7 + "AKIA" + "B" * 30, "a" * 23, "a" * 24, "f" * 100_000, "g" + "0" * 24 + "G" + "1" * 23,
             good, good + "x", good + "_", good + "-", good[:-1] + "!", good[:-1] + "0" if good[-1] != "0" else good[:-1] + "1", npm, "token: " + npm, "漢字" + good + " " + npm, age, age.lower(), age[:-1] + ("Q" if age[-1] != "Q" else "P"),
             "x" + age, "toKen=abcdef ſecret=abcdef", "secret = \"" + "Q" * 200_000, "token=abcdef " * 3000, "ghp_" + "a" * 36, "'token'='abcdef'", "token '= abcdef", "token\t=abcdef"]
    bits = ["token", "SECRET", "api_key", "passwd", "password", "=", ":", " ", "'", '"', "abc", "é", "漢", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "deadbeef", "z", "-", "\n", "ghp_", good, npm, age]
    return texts + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]


def test_spans_against_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i % 400, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = sorted((r.doc_id, [(s.start, s.end, s.kind) for s in r.secrets]) for r in S.scan_secrets(df).collect())
    assert got == sorted((i % 400, brute(t)) for i, t in enumerate(texts))
    assert {k for _, spans in got for _, _, k in spans} == set(S.KINDS)
    assert S.scan_secrets(df.limit(0)).count() == 0


def test_digests_against_brute_force_and_sql(spark):
    texts = [t for t in cases() if t is None or len(t) < 5000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[30]), (3, texts[30])]
    got = sorted(map(repr, (tuple(r) for r in S.secret_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    want = []
    for i, t in rows:
        spans = brute(t)
        listed = lambda of: ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in of)
        count = [sum(x[2] == k for x in spans) for k in S.KINDS[:3]]
        want.append(repr((i, *count, hashlib.sha256(listed(S.KINDS[:3]).encode()).hexdigest(), listed(S.KINDS))))
    assert got == sorted(want)
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    con.register("documents", documents)
    assert sorted(map(repr, con.execute(ORACLES["op11_secret_scan"]).fetchall())) == got


def test_texts_side_by_side_do_not_run_together():
    texts = ["tok", "en=abcdef", "a" * 12, "a" * 12, "b" * 30, "b" * 24, "token", "=abcdef", "AKIA", "A" * 20, "token=", "abcdef"]
    assert S.spans_of(pa.array(texts)) == [brute(t) for t in texts]
    assert S.spans_of(pa.array(texts).slice(3, 3)) == [brute(t) for t in texts[3:6]]
    for at in range(40):
        t = "x" * at + "0" * 24 + "y" * 3 + "1" * 23
        assert S.spans_of(pa.array(["zz", t])) == [[], [(at, at + 24, "hex")]]


def test_checksums():
    assert S.crc_holds(forge("gho", "q" * 30).encode()) and not S.crc_holds(("gho_" + "q" * 36).encode())
    assert S.bech32_holds(b"A12UEL5L") and S.bech32_holds(b"abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxw")  # examples of the format's definition
    assert not S.bech32_holds(b"A12UEL5Q")
