import hashlib
import re

from conftest import frame

from sparkprep.llm import secrets
from sparkprep.llm.common import scratch_path

PATTERNS = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
            (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]
KINDS = ["assign", "access", "hex"]


def base(text):
    found = [(m.start(), i, m.end()) for i, (p, g, least) in enumerate(PATTERNS)
             for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(KINDS[i], s, e) for s, i, e in sorted(found)]


HEX, KEY = "deadbeef" * 4, "AKIA" + "Z9" * 10
TEXTS = ["no secret here", f"🙂é password = 'hunter22' and {HEX} {KEY}", "secret=token: abcdefgh", "token: abc password=longvalue",
         f"API_KEY\"  : \"{HEX}\"", "AKIASHORT " + KEY[:19], HEX[:23] + " " + HEX[:24], "Passwd:x/y+z=. tokentoken=123456", None, "",
         f"{HEX} " * 300, "apikey=" + "k" * 5000, "PASSWORD=AKIA" + "B" * 18, "ſecret=abcdefgh toKen=abcdefgh",
         "-----BEGIN RSA PRIVATE KEY-----\nabc", "see https://bob:pa55word@host/x", "secret = \n abcdefg", "a" * 23 + "g" + "b" * 24]


def expected(docs):
    out = []
    for i, t in docs:
        spans = base(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        out.append((i, *[sum(k == x for k, _, _ in spans) for x in KINDS], hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    rows = secrets.digest(df).collect()
    return sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows), key=repr), rows


def test_equals_brute_force(spark):
    docs = list(enumerate(TEXTS)) + [(50 + i, t) for i, t in enumerate(TEXTS[:6])]
    got, rows = result(frame(spark, docs))
    assert got == expected(docs)
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[14] == "pem:0:31" and spans[15].startswith("login:4:") and spans[0] == ""


def test_null_and_repeated_ids(spark):
    docs = [(1, TEXTS[1]), (1, TEXTS[1]), (None, TEXTS[1]), (None, TEXTS[2]), (2, TEXTS[2]), (2, None), (None, None)]
    assert result(frame(spark, docs))[0] == expected(docs)


def test_empty_table(no_documents):
    assert result(no_documents)[0] == []


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark):
    ledger = scratch_path(spark, "ledger")
    rules = secrets.BASE_RULES

    def scans():
        return sorted((r.rule, r.version) for r in spark.read.schema(secrets.LEDGER).parquet(ledger).collect())

    first = frame(spark, [(1, TEXTS[1]), (2, TEXTS[0]), (3, TEXTS[1])])
    secrets.scan_history(first, ledger, rules=rules)
    assert scans() == sorted([(k, 1) for k in KINDS] * 2)
    found = secrets.scan_history(first.union(frame(spark, [(4, TEXTS[6]), (5, TEXTS[0])])), ledger, rules=rules)
    assert scans() == sorted([(k, 1) for k in KINDS] * 3)          # one new blob
    assert {r.doc_id: len(r.hex) for r in found.collect()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0}
    newer = (*rules[:2], secrets.Rule("hex", "[0-9a-f]+", version=2, least=23))
    found = secrets.scan_history(frame(spark, [(4, TEXTS[6]), (2, TEXTS[0])]), ledger, rules=newer)
    assert [x for x in scans() if x[1] == 2] == [("hex", 2)] * 2   # known blobs, one changed rule
    assert {r.doc_id: len(r.hex) for r in found.collect()} == {2: 0, 4: 2}


def test_plan_has_no_python(spark, documents):
    plan = secrets.digest(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
