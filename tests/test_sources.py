import os
import re
import pytest
from pyspark.sql import functions as F

from limpid.functions import encoding
from limpid.plans import run
from limpid.sources import config, files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_bytes("eins\r\nzwei é\r# no\n".encode())
    (tmp_path / "in" / "b.csv").write_bytes(b"\xef\xbb\xbfdrei")
    (tmp_path / "in" / "c.log").write_bytes("vier é".encode("cp1252"))
    (tmp_path / "in" / "d.dat").write_bytes(b"\xff\xfe" + "fünf".encode("utf-16le"))
    (tmp_path / "in" / "e.zip").write_bytes(b"no")
    (tmp_path / "in" / "deep").mkdir()
    (tmp_path / "in" / "deep" / "f.txt").write_bytes(b"no")
    return tmp_path


def test_inputs(spark, folder):
    names = {r.path.rsplit("/", 1)[1] for r in files.read_lines(spark, f"{folder}/in").collect()}
    assert names == {"a.TXT", "b.csv", "c.log", "d.dat"}
    assert files.read_lines(spark, f"{folder}/in/a.TXT").count() >= 2


def test_decoded(spark, folder):
    rows = files.read_decoded(spark, f"{folder}/in").collect()
    by = {(r.path.rsplit("/", 1)[1], r.line_no): (r.line, r.encoding, r.had_bom) for r in rows}
    assert by[("a.TXT", 2)] == ("zwei é", "utf-8", False)
    assert by[("b.csv", 1)] == ("drei", "utf-8", True)
    assert by[("c.log", 1)] == ("vier é", "windows-1252", False)
    assert by[("d.dat", 1)] == ("fünf", "utf-16le", True)


def test_detection_cases():
    assert encoding.detect_bytes(None) == (None, False, False)
    assert encoding.detect_bytes(b"") == ("utf-8", False, True)
    assert encoding.detect_bytes(b"\0\x01\x02\x98", fallback="x") == ("x", False, False)
    assert encoding.detect_bytes(b"\xe9", "latin-1") == ("iso8859-1", False, True)
    assert encoding.detect_bytes(b"\xe9", "no-such") == ("utf-8", False, True)
    # a character cut by the sample is not an error
    assert encoding.detect_bytes("é".encode() * 5000, sample=8191)[0] == "utf-8"


def test_detection_takes_the_whole_content(spark, tmp_path):
    ascii_ = b"plain\n" * 2000
    cases = [None, b"", b"a", ascii_, ascii_ + "é".encode(), ascii_ + b"\xe9t\xe9", ascii_ + b"\xc3", ascii_ + b"\xe9\x81", b"\x81\x8d", b"\xe9" + ascii_ + b"\x81", b"\xff\xfea\0", b"\xef\xbb\xbfa\xff", b"\xed\xa0\x80", b"\xc0\x80", b"\0\x7f"]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    for label in ("auto", "latin-1"):
        got = {r.i: tuple(r.d) for r in df.select("i", encoding.detected(F.col("c"), label).alias("d")).collect()}
        assert got == {i: encoding.detect_bytes(c, label) for i, c in enumerate(cases)}
    assert encoding.detect_bytes(cases[5])[:2] == ("windows-1252", False)
    (tmp_path / "late.txt").write_bytes(ascii_ + b"\xe9t\xe9")
    last = [r.line for r in files.read_decoded(spark, str(tmp_path)).collect()][-1]
    assert last == "été"


SAMPLES = {
    "Привет, как дела? Сегодня хорошая погода, и мы пошли гулять.": ("windows-1251", "koi8-r", "utf-16le", "utf-16be"), "value = 'привет' # комментарий к коду, x = 5": ("windows-1251", "koi8-r"),
    "Où est passé le garçon français à côté de l'été, déjà célèbre?": ("windows-1252", "utf-16le"), "Die Straße führt über größere Flüsse — schöne Grüße!": ("windows-1252", "utf-16be"), "vier é": ("windows-1252",),
    "今天天气很好，我们去公园散步。你好世界": ("gb18030", "utf-16le", "utf-16be"), "今日は天気がいいので、公園へ散歩に行きました。カタカナ": ("shift_jis", "euc_jp", "utf-16le"), "오늘은 날씨가 좋아서 공원에 산책하러 갔습니다.": ("euc_kr",),
    "Σήμερα ο καιρός είναι πολύ καλός και πήγαμε βόλτα.": ("windows-1253",), "今天天氣很好,我們去公園散步,謝謝大家": ("big5",), "plain words": ("utf-16le", "utf-16be", "utf-8"), "nul \0 and \x01": ("utf-8",),
}


def test_detection_by_content(spark):
    cases = [(bytearray((text + "\n").encode(name) * k), name) for text, names in SAMPLES.items() for name in names for k in (1, 400)]
    cases.append((bytearray(b"x" * 20_000 + "größte".encode("cp1252")), "windows-1252"))
    for content, name in cases:
        assert encoding.detect_bytes(bytes(content))[0] == name, (bytes(content)[:40], name)
    df = spark.createDataFrame(cases, "c binary, want string")
    got = df.select(encoding.detected(F.col("c")).alias("d"), "c").collect()
    assert all(tuple(r.d) == encoding.detect_bytes(bytes(r.c)) for r in got)
    assert not encoding.detect_bytes("vier é".encode("cp1252"))[2] and encoding.detect_bytes(b"\xff\xfe\x00", fallback="x")[1:] == (True, True)


KEYED = config.Config(output=config.Output(quarantine_key="k"))


def test_no_sink_holds_a_secret(spark, tmp_path):
    """Records of a site, an account and a secret in every layout, and secrets in prose: in no file of a run, intermediate ones included."""
    from limpid import session

    m = "Zq7MARKERzz99"
    rows = [
        f"https://site.example/login:joe:{m}", f"https://site.example:joe@mail.example:{m}", f"https://site.example:8443/a:joe:{m}", f"site.example:joe:{m}", f"www.site.example/x|joe|{m}", f"joe:{m}:https://site.example/",
        f"joe@mail.example:{m}", f"joe@mail.example {m}", f"https://site.example,joe,{m}", f"https://site.example\tjoe\t{m}", f"https://site.example joe {m}", f"joe;{m};https://site.example", f"android://x@com.app/:joe:{m}",
        f"see https://site.example/a:joe:{m} and more", f"# password: {m}", f"wrote to joe@mail.example:{m} today", f"api_key = {m}", f"https://joe:{m}@site.example/", f"token k9{m}aB3xY7pQ2wE5 was used", "plain text stays",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(rows))
    session.clean_up(spark)
    stats = run.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", KEYED)
    shared = re.sub("^file:/*", "/", session.shared_dir(spark))
    places = [f"{tmp_path}/out", *[f"{shared}/{x}" for x in os.listdir(shared)]]
    assert len(places) > 1 and stats["n_lines"] == len(rows)
    for place in places:
        for root, _, names in os.walk(place):
            for name in names:
                assert m.encode() not in open(f"{root}/{name}", "rb").read(), (root, name)
    for kind in ("clean", "quarantine"):
        assert not any(m in str(r) for r in spark.read.parquet(f"{tmp_path}/out/{kind}").collect())
    clean = {r.line for r in spark.read.parquet(f"{tmp_path}/out/clean").collect()}
    assert "plain text stays" in clean and "token [TOKEN] was used" in clean and "wrote to [EMAIL]:[JOINED] today" in clean
    assert spark.read.parquet(f"{tmp_path}/out/quarantine").where("reject_reason = 'credential'").count() >= 13


def test_lossy(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"), "utf-8"), (bytearray(b"\xe9"), "windows-1252"), (None, "utf-8")], "c binary, e string")
    got = df.select(encoding.decode_utf8(F.col("c")).alias("u"), encoding.decode_lossy(F.col("c"), F.col("e")).alias("d")).collect()
    assert [r.d for r in got] == ["a�b", "é", None]
    assert [r.u for r in got] == ["a�b", "�", None]


def test_chunks(spark):
    mb = 1 << 20
    assert [files.split_size(s, 4) for s in (0, 256 * 8 * mb, 10**15)] == [4 * mb, 8 * mb, 256 * mb]
    got = spark.createDataFrame([(0,), (256 * 8 * mb,), (10**15,)], "s bigint").select(files.chunk_bytes(F.col("s"), F.lit(4)).alias("c")).collect()
    assert [r.c for r in got] == [4 * mb, 8 * mb, 256 * mb]


def test_config(tmp_path):
    assert config.load(tmp_path / "none.toml") == config.Config()
    (tmp_path / "a.toml").write_text('[lines]\nskip_prefixes = ["%"]\nmax_line_bytes = 9\n')
    got = config.load(tmp_path / "a.toml")
    assert got.lines.skip_prefixes == ("%",) and got.lines.max_line_bytes == 9 and got.urls == config.Urls()
    (tmp_path / "b.toml").write_text("[lines\n")
    with pytest.raises(Exception):
        config.load(tmp_path / "b.toml")
    (tmp_path / "c.toml").write_text("[lines]\nno_such = 1\n")
    with pytest.raises(ValueError, match="no_such"):
        config.load(tmp_path / "c.toml")


def test_run(spark, folder):
    with pytest.raises(ValueError, match="quarantine_key"):
        run.run(spark, f"{folder}/in", f"{folder}/out")
    told = []
    stats = run.run(spark, f"{folder}/in", f"{folder}/out", KEYED, tell=told.append)
    assert all(x["done"] <= x["of"] for x in told)
    assert (stats["n_kept"], stats["n_rejected"]) == (5, 1)
    clean = {r.line for r in spark.read.parquet(f"{folder}/out/clean").collect()}
    assert clean == {"eins", "zwei é", "drei", "vier é", "fünf"}
    bad = spark.read.parquet(f"{folder}/out/quarantine").collect()
    assert [r.reject_reason for r in bad] == ["prefix"] and "no" not in bad[0].line_hmac.split()
    assert spark.read.json(f"{folder}/out/stats").first().n_lines == stats["n_lines"]


def test_figures(spark):
    assert run.number(1234567) == "1,234,567"
    assert [run.speed(n, 1) for n in (5, 1500, 2_500_000)] == ["5/s", "1.5K/s", "2.5M/s"]
    assert [run.duration(s) for s in (5, 65, 3661)] == ["0:05", "1:05", "1:01:01"]
    assert run.rate(5, 0) == 0 and run.remaining(0, 5, 1) is None and run.remaining(2, 6, 1) == 2
    assert run.workers() >= 1 and run.cancel(spark, "nothing") == [] and run.progress(spark, print) == []


def test_run_takes_urls_through_all_stages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(
        "go HTTP://Ex.COM:80/Aé now\ngo http://ex.com/A now\nhttps://b_d/x\nhttps://b.de/" + "x" * 2100 + "\n"
        "tab\tstays\x01\ntab\tstays\ngopher://old.org/x\nmail a@b.de\nmail c@b.de\nhttps://C.de:443/P/q"
    )

    def result(name, toml=""):
        (tmp_path / f"{name}.toml").write_text('[output]\nquarantine_key = "k"\n' + toml)
        stats = run.run(spark, f"{tmp_path}/in", f"{tmp_path}/{name}", config.load(tmp_path / f"{name}.toml"))
        clean = sorted((r.line_no, r.line, r.url) for r in spark.read.parquet(f"{tmp_path}/{name}/clean").collect())
        bad = sorted((r.line_no, r.reject_reason) for r in spark.read.parquet(f"{tmp_path}/{name}/quarantine").collect())
        assert stats["n_kept"] == len(clean) and stats["n_rejected"] == len(bad) and stats["n_lines"] == 10 == len(clean) + len(bad) + stats["n_empty"] + stats["n_duplicates"]
        return clean, bad

    clean, bad = result("plain")
    text_ = [(5, "tab\tstays", None), (7, "gopher://old.org/x", None), (8, "mail [EMAIL]", None), (9, "mail [EMAIL]", None)]
    assert clean == [(1, "go http://ex.com/A now", "http://ex.com/A"), *text_, (10, "https://c.de/P/q", "https://c.de/P/q")]
    assert bad == [(3, "url_pattern"), (4, "url_too_long")]
    clean, bad = result("set", '[urls]\nmax_bytes = 3000\nclean = false\nstrip_default_ports = false\nstrip_paths = true\nreject_unknown_schemes = true\nemail_pattern = "a@b"\n')
    assert [c[2] for c in clean] == ["HTTP://ex.com:80", "http://ex.com", "https://b.de", None, None, None, "https://c.de:443"]
    assert [c[1] for c in clean if c[1].startswith("mail")] == ["mail [EMAIL].de", "mail c@b.de"] and bad == [(3, "url_pattern"), (7, "url_scheme")]
    assert [c[2] for c in result("pattern", '[urls]\nurl_pattern = "gopher://\\\\S+"\n')[0] if c[2]] == ["gopher://old.org/x"]


def test_large_files_are_split(spark, tmp_path):
    body = "".join(f"{i} line {'x' * (i * 7919 % 1000)}" + ("\r\n", "\n", "\r")[i % 3] for i in range(1500)) + "last"
    (tmp_path / "a b.txt").write_bytes(body.encode() * 12 + "é".encode())
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + body.encode() * 7 + b"\xff")
    (tmp_path / "c.log").write_bytes(body.encode() * 12 + "é€".encode("cp1252"))
    (tmp_path / "d.dat").write_bytes(b"\xff\xfe" + (body * 4).encode("utf-16le"))
    (tmp_path / "e.txt").write_bytes(b"few\nlines")
    want = {tuple(r) for r in files.read_decoded(spark, str(tmp_path)).collect()}
    with files.splitting(spark, str(tmp_path)):
        got = files.read(spark, str(tmp_path))
        rows = {tuple(r) for r in got.collect()}
        tasks = got.where(F.col("path").endswith("c.log")).select(F.spark_partition_id()).distinct().count()
    assert rows == want and tasks > 1
    assert [files._by_lines(x) for x in ("utf8", "cp1252", "koi8-r", "utf-16le", "gbk", "cp037")] == [True, True, True, False, False, False]
    run.run(spark, str(tmp_path), f"{tmp_path}/out", KEYED)
    assert spark.read.parquet(f"{tmp_path}/out/clean").where("line = 'lasté€'").count() == 1
