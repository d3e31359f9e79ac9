import math
from collections import Counter

from pyspark.sql import functions as F

from limpid.functions import lines, text
from limpid.operators import validate


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("u"))).collect()]


def test_plain_functions(spark):
    assert apply(spark, lines.line_ends, ["a\r\nb\rc\n", None]) == ["a\nb\nc\n", None]
    assert apply(spark, lines.trim, ["　 a b \n", "", None]) == ["a b", "", None]
    assert apply(spark, lines.unquote, ['"a"', "'a'", "\"a'", '"', '""', "'x\ny'", None]) == ["a", "a", "\"a'", '"', "", "x\ny", None]
    assert apply(spark, lines.printable, ["a\tbé~ "]) == ["ab~ "]
    assert apply(spark, lines.drop_controls, ["a\tb\x00\x85c"]) == ["a\tbc"]
    assert apply(spark, lines.guard_cell, ["=1+1", " -x", "a=b", "@x", "\t=x", None]) == ["'=1+1", "'-x", "a=b", "'@x", "'=x", None]
    assert apply(spark, lines.too_long, ["é" * 2049, "é" * 2048]) == [True, False]
    assert apply(spark, lines.bare_scheme, ["HTTP://", "http://a", ""]) == [True, False, False]
    assert apply(spark, lines.skipped, ["# x", "//x", "--x", "x#", ""]) == [True, True, True, False, False]


def test_shapes(spark):
    values = ["HTTPS://a.b", "www.a.b", "//a.b", ".a.b", "..a.b", "abc", "ftp", "1.2.3.4:80", "1.2.3.256", "1.2.3.4.5", "10.0.0.1", None]
    assert apply(spark, lines.shape, values) == ["url_first", "www_first", "slash_slash", "leading_dot", *["unknown"] * 7, None]
    assert apply(spark, lines.shape_or_ip, values)[7:11] == ["ip_first", "unknown", "unknown", "ip_first"]


def test_entropy(spark):
    values = ["aab", "abcd", "aaaa", "", None, "xy" * 500]
    got = apply(spark, lines.entropy, values)
    for v, g in zip(values, got, strict=True):
        if v is None:
            assert g is None
        else:
            n = len(v)
            assert abs(g - sum(-k / n * math.log2(k / n) for k in Counter(v).values())) < 1e-9


def test_reason_order_and_statistics(spark):
    rows = [(1, "a:b\r\n\r\n# c\nhttp://\n" + "x" * 5000), (2, ""), (3, None)]
    judged = validate.hygiene_lines(spark.createDataFrame(rows, "id int, t string"), "t", ["id"])
    got = {(r.id, r.line_no): r.reject_reason for r in judged.collect()}
    assert got == {(1, 1): None, (1, 2): "empty", (1, 3): "prefix", (1, 4): "bare_scheme", (1, 5): "too_long", (2, 1): "empty"}
    s = validate.run_statistics(judged, "line").first()
    assert (s.n_lines, s.n_kept, s.n_empty, s.n_rejected) == (6, 1, 2, 3)
    none = validate.run_statistics(judged.limit(0), "line").first()
    assert (none.n_lines, none.n_bytes) == (0, 0)


def test_clean_and_quarantine_make_the_input(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["http://a.b", "x", None, "", "http://a_b", "ssh://c:22/x"])], "i int, url string")
    clean, bad = validate.split(df, validate.url_reason(F.col("url"), known_only=True))
    assert clean.count() + bad.count() == 6
    assert {r.i: r.reject_reason for r in bad.collect()} == {1: "scheme", 2: "empty", 3: "empty", 4: "pattern"}


def test_no_secret_leaks(spark):
    marker = "Zq7MARKERzz99"
    rows = [f"https://joe:{marker}@h.example/x", f"password = '{marker}'", f"api_key: {marker}", f"Authorization: Bearer {marker}{marker}", f"client_secret=\"{marker}\""]
    out = apply(spark, text.redact, rows)
    assert not any(marker in o for o in out)
    df = spark.createDataFrame([(r, "prefix") for r in rows], "line string, reject_reason string")
    kept = validate.quarantine(df, "line", [], "key").collect()
    assert not any(marker in str(r) for r in kept)
    assert len({r.line_hmac for r in kept}) == len(rows)


def test_redaction_kinds(spark):
    got = apply(spark, text.redact, ["mail a.b@c.example or 10.0.0.1, card 4111 1111 1111 1111, +44 7700 900123", None, "plain"])
    assert got == ["mail [EMAIL] or [IPV4], card [CARD], [PHONE]", None, "plain"]


def test_patterns(spark):
    assert apply(spark, text.first_url, ["see http://a.b/c d", "none", None]) == ["http://a.b/c", None, None]
    joined = ["https://a.example/login:joe:pw", "https://a.example:joe@b.example:pw", "https://a.example:8443/x:joe", "x https://a.example:443:joe:pw", "http://a.example:99999999", "http://a.example:80", "http://a.example:80, b", "http://a.example?q#f"]
    want = ["https://a.example/login", "https://a.example", "https://a.example:8443/x", "https://a.example", "http://a.example", "http://a.example:80", "http://a.example:80", "http://a.example?q#f"]
    assert apply(spark, text.first_url, joined) == want
    assert apply(spark, lambda c: text.first_url(c, "x+"), ["axxb"]) == ["xx"]
    assert apply(spark, text.has_email, ["a@b.cd", "a@b"]) == [True, False]
    assert apply(spark, text.nfc, ["é", "plain", "é", "하", None]) == ["é", "plain", "é", "하", None]


def test_lines_that_are_no_credentials(spark):
    rows = [
        "see https://en.example/wiki/Main_Page for more", "https://a.example/x?y=1", "http://a.example:8080/x", "at 10:20:30 the job ended", "src/main.c:10:5: error", "a.b@c.example", "key: value", "http://a.example is down now",
        "git remote add up git@forge.example:a/b.git", "", None, "Note: see https://a.example/x", "x" * 50_000, "a:b", "commit 3f2a9c", "From: Ann Lee <a.lee@c.example>",
    ]
    assert apply(spark, text.credential_line, rows) == [None if r is None else False for r in rows]


def test_random_tokens(spark):
    rows = ["id aB3xY7pQ2wE5rT8uI0oL6kJ4 end", "3f2a9c1b3f2a9c1b3f2a9c1b3f2a9c1b3f2a9c1b", "src/Module1/handlers/AccountHandler", "ThisIsALongIdentifierWithWords2", "a" * 40, "", None]
    got = apply(spark, text.redact, rows)
    assert got[0] == "id [TOKEN] end" and got[1:3] == rows[1:3] and got[4:] == rows[4:]


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    for key in ("k", "x" * 64, "long" * 40):
        got = apply(spark, lambda c: text.keyed_hash(c, key), ["", "aé", None])
        assert got == [*(hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in ("", "aé")), None]


def test_entropy_against_brute_force(spark):
    import collections
    import math

    rows = ["", "a", "aab", "abcd", "aaaa", "ééx🔑🔑", "the quick brown fox " * 500]
    want = [sum(-n / len(t) * math.log2(n / len(t)) for n in collections.Counter(t).values()) for t in rows]
    assert all(abs(g - w) < 1e-9 for g, w in zip(apply(spark, lines.entropy, rows), want, strict=True)) and apply(spark, lines.entropy, [None]) == [None]
