"""Garbled text, look-alikes, leakage and personal data."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limpid.llm import leakage, lookalike, mojibake, pii

NAMES = ["Søren Çelik", "naïve Zoë", "Ångström", "größte", "мирослав", "Θεόδωρος", "桜木野", "林远岚", "façade"]


@pytest.mark.parametrize("text", NAMES)
@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman"])
def test_round_trip_of_utf8(text, read_as):
    raw = text.encode()
    try:
        wrong = raw.decode(read_as)
    except UnicodeDecodeError:
        pytest.skip("no such garbling")
    garbled, restored = mojibake.repair(wrong)
    assert garbled and restored == text


LEGITIMATE = """
    Пётр Фёдор Алёна Семён Артём Матвей Юлия Юля Эхо Жук Щит Ирина Ольга Татьяна Наталья Екатерина Александр Дмитрий Сергей Андрей Алексей Михаил Иван
    Николай Владимир Евгений Анастасия Мария Анна Елена Светлана Людмила Галина Валентина Виктор Игорь Олег Юрий Павел Роман Денис Антон Максим Кирилл
    Никита Илья Егор Тимофей Лев Глеб Ян Эмма Ёлка ёжик Щербаков Хрущёв Цветаева Шолохов Жданов ПЁТР ФЁДОР АЛЁНА Іван Олександр Володимир Наталія Їжак
    Ґанна Євген Юрій Андрій Ђорђе Његош Љубав Џон Ѓорѓи Ќирил Ўладзімір Алесь Ångström Åsa Øyvind Søren Bjørn Håkon Jürgen Günther Müller Größe Weiß Jörg
    Änne Özil Émile Zoë Chloë Noël François Françoise Héloïse Gaëlle Benoît Jérôme André Léa Inès Aïcha Anaïs Éléonore ÉLÉONORE FRANÇOIS JÜRGEN MÜLLER
    ÖZGÜR Çağlar Şebnem Işıl Gülşen İbrahim Ömer Ümit Ayşe Tuğba Güneş Çiğdem José María Íñigo Begoña Núñez Muñoz Peña Ibáñez Álvaro Óscar Ángel Sofía
    Lucía João Conceição Inês Antônio Luís Gonçalves Simões Magalhães IRMÃ MAÇÃ São Zdeněk Jiří Dvořák Růžena Šárka Žofie Čeněk Ľubomír Ľudovít Štefan
    Łukasz Małgorzata Paweł Błażej Żaneta Świętosława Źródło Ćwikła Gżegżółka Õnne Ülo Jüri Märt Pärt Āris Jānis Ķīlis Ņina Ģirts Šarūnas Žydrūnas Eglė
    Čiurlionis Ștefan Țăndărică Ionuț Mădălina Căline Győző Özséb Örs Ágnes Éva Lőrinc Ödön Űrhajós Þór Ólafur Björk Guðrún Ðorin Ægir Ísak Æthel Œuvre
    cœur Đỗ Nguyễn Trần Phạm Huỳnh Vũ Đặng Bùi Hồ Ngô Dương Lý Hoàng Phương Thảo Ngọc Γιώργος Ελένη Κωνσταντίνος Μαρία Δημήτρης Αικατερίνη Νίκος Άννα
    Θεόδωρος Ξένια Ψάλτης Ωραία ΓΙΩΡΓΟΣ Ζωή Χρήστος Σοφία Φώτης Ηλίας Ρένα Ύδρα Όλγα Ίρις Έφη 王伟 李娜 张敏 刘洋 陈静 杨柳 赵磊 黄蓉 周杰 吴刚 徐霞 孙权 马云 朱元璋 胡适 郭靖 林黛玉 何炅 高明
    梁启超 郑和 罗成 宋江 谢娜 唐寅 韩信 曹操 许仙 邓超 萧峰 冯唐 曾国藩 程咬金 蔡琴 彭德怀 潘安 袁隆平 于谦 董卓 余华 苏轼 叶问 吕布 魏 魏征 魏延 蒋干 田单 杜甫 丁真 沈从文 姜子牙 范蠡 江姐 傅雷 钟馗 卢俊义 汪精卫 戴望舒 崔健 任贤齐 陆游 廖化 姚明 方世玉
    金庸 邱少云 夏雨 谭嗣同 韦小宝 贾宝玉 邹容 石崇 熊猫 孟子 秦始皇 阎锡山 薛涛 侯宝林 雷锋 白居易 龙飞 段誉 郝思嘉 孔子 邵逸夫 史可法 毛泽东 常香玉 万章 顾城 赖昌星 武松 康熙 贺龙 严复 尹志平 钱学森 施耐庵 牛顿 洪七公 龚自珍 茅盾 茅 梅兰芳 陶渊明 田中 太郎
    桜井 美咲 佐藤 健 鈴木 一郎 高橋 渡辺 伊藤 山本 中村 小林 加藤 さくら ひなた はると ゆい あおい ハルト サクラ タロウ ケンジ ナツミ コンピュータ 김민준 이서연 박지훈 최수빈 정예은 강하늘 조인성 윤아 장동건 임창정 한가인 오세훈 서태지 신동엽 권상우 황정민 안성기
    송혜교 유재석 홍길동 محمد أحمد فاطمة علي حسن حسين مريم عائشة خالد عمر يوسف ابراهيم زينب سارة نور ליאור דוד שרה משה רחל יעקב מרים אברהם יוסף חנה राम सीता कृष्ण
    गीता अर्जुन प्रिया राहुल अनिता সুমন রবীন্দ্রনাথ கமல் ரஜினி தமிழ் సత్య ಕನ್ನಡ മലയാളം ગુજરાત ਪੰਜਾਬ ไทย สมชาย สุดา มานี გიორგი ნინო დავით თამარ Արմեն Անի
    Գարիկ Հայկ Նարե ሰላም አበበ ខ្មែរ ລາວ မြန်မာ 林黛玉1 陳大文 黃飛鴻 張學友 劉德華 郭富城 黎明 梁朝偉 周潤發 釋行宇 größte naïve façade café résumé piñata smörgåsbord jalapeño crème
    brûlée Ålesund Ærø ÅÄÖ ÄÖÜ äöü éà ÉÀÈ öö üü ß ÿ ñ Ñandú Ñ º ª £100 €50 ¥500 §12 ©2024 ®x ™ ±1 °C µm ½ ¼ «mot» “x” ‘y’ a–b c—d e… ¡hola! ¿qué? naïf±1
    café¹ piñata° Jalapeño™ Señor€ ÿes Zoé² l’été d’Été ÉCLÂT Âncora ÂNGULA Ãmbar ãmbar Îles île Ïambe Þing
""".split()


def test_legitimate_names_are_left_alone():
    assert len(LEGITIMATE) > 450
    forms = dict.fromkeys(f for t in LEGITIMATE for f in (t, t.upper(), t.lower(), t + "_77"))
    spoken = ["Пётр Иванов", "Алёна и Семён", "irmã maria", "IRMÃ MARIA", "maçã verde", "à la carte", "“Пётр”", "«Фёдор»", "SÃO JOÃO", "são joão", "déjà vu", "DÉJÀ VU", "x Ã y", "Ё", "Ã", "Â"]
    assert {t: mojibake.repair(t) for t in [*forms, *spoken] if mojibake.repair(t) != (False, t)} == {}


def garble(text, read_as):
    """UTF-8 read as an encoding; bytes that cp1252 leaves undefined as C1 controls, None where others are undefined."""
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(read_as))
        except UnicodeDecodeError:
            if read_as != "cp1252":
                return None
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("layers", range(1, 7))
def test_layers_of_any_number(layers):
    done = total = 0
    for name in LEGITIMATE[layers::6]:
        for read_as in mojibake.READ_AS:
            wrong = name
            for _ in range(layers):
                wrong = wrong and garble(wrong, read_as)
            if wrong:
                total += 1
                done += mojibake.repair(wrong) == (True, name)
    assert total > 300 and done >= 0.98 * total


def test_mixed_layers():
    for ways in (("cp1252", "mac_roman"), ("cp437", "cp1252", "mac_roman"), ("koi8_r", "cp850"), ("cp1252", "cp1252", "cp437")):
        wrong = "Žofie größte мирослав"
        for read_as in ways:
            wrong = garble(wrong, read_as)
        assert mojibake.repair(wrong) == (True, "Žofie größte мирослав")


def test_values_changed_after_garbling():
    assert mojibake.repair("ã§andrio") == (True, "çandrio") and mojibake.repair("ð²ðµð»ð¾ñ€ð°") == (True, "велора")
    assert mojibake.repair("crÃ mon verde") == (True, "cràmon verde")


def test_legacy_pairs():
    assert mojibake.repair("мирослан".encode("cp1251").decode("cp1252")) == (True, "мирослан")
    assert mojibake.repair("zoënne".encode("cp1252").decode("cp437")) == (True, "zoënne")
    assert mojibake.repair("çandrio".encode("cp1252").decode("cp1251")) == (True, "çandrio")


@pytest.mark.parametrize("text", [*NAMES, "ÂNGULA", "IRMÃ", "MAÇÃ", "Âncora", "£rider", "café¹", "piñata°", "été©", "Ålesk™", "«pine»", "“x”", "a… b", "newika°18669🔑", "велора_smith", "é́", "x y", "ÐORIN", "Пётр"])
def test_legitimate_text_is_left_alone(text):
    assert mojibake.repair(text) == (False, text)


def test_lost_and_empty():
    assert mojibake.repair("j�rvin")[0] and mojibake.repair("a\x81b")[0]
    assert mojibake.repair(None) == (False, None) and mojibake.repair("") == (False, "") and mojibake.repair("plain") == (False, "plain")
    long = "x" * 100_000 + "Ã©"
    assert mojibake.repair(long) == (True, "x" * 100_000 + "é")


def test_find_garbled(spark):
    rows = [(1, "sÃ©baro", "u"), (2, "sébaro", "u"), (3, None, None), (4, "", "u"), (1, "sÃ©baro", "u"), (None, "sÃ©baro", "u")]
    df = spark.createDataFrame(rows, "id int, name string, original string")
    got = [tuple(r) for r in mojibake.find_garbled(df, "id", "name", "f").collect()]
    assert got == [("f", 1, "sÃ©baro", "sébaro")] * 2
    assert mojibake.find_garbled(df.limit(0), "id", "name", "f").count() == 0


# ---------------------------------------------------------------- look-alikes


@pytest.fixture(scope="module")
def form(spark):
    return lookalike.Form(lookalike.lookalikes(spark))


def test_canonical_forms(form):
    same = ["https://ex.com/a-b", "ｈｔｔｐｓ：／／ｅｘ．ｃｏｍ／ａ－ｂ", "httрѕ://ех.соm/а-b", "https://ex․com/a‐b", "htt‍ps://ex.c­om/a-b﻿"]
    assert {form.canonical(t) for t in same} == {same[0]}
    assert form.canonical("ﬁle") == "file" and form.canonical("é") == "é" and form.canonical("a　b c") == "a b c"
    different = ["file", "File", "fíle", "fi1e", "f-ile", "f_ile", "naif1", "naif¹"]
    assert len({form.canonical(t) for t in different}) == len(different)
    assert form.canonical(None) is None and form.canonical("") == ""
    assert form.canonical("e​́") == "é" and form.canonical("и̮") == "и̮"


def test_look_alikes_of_many_alphabets(form):
    assert form.canonical("аеорсхуіј") == "aeopcxyij" and form.canonical("АВЕКМНОРСТХІ") == "ABEKMHOPCTXI"
    assert form.canonical("αιυορν") == "aiuopv" and form.canonical("ꓐꓑ") == "BP" and form.canonical("Ꮃⲟ𐐬") == "Woo"
    assert form.canonical("ά") == "á" and form.canonical("ı") == "ı" and form.canonical("ø") == "ø" and form.canonical("ł") == "ł"
    assert len(form.table) > 500 and all(k > "\x7f" and v.isascii() and v.isalpha() for k, v in form.table.items())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aеéé ̈​ｅﬁ．－ᄀ가ᅡ漢и�힣ά"), max_size=12))
def test_canonical_is_idempotent_and_whole(form, text):
    once = form.canonical(text)
    assert form.canonical(once) == once
    # splicing gives what folding every character and composing the whole gives
    whole = unicodedata.normalize("NFC", "".join(form.fold(c) for c in text))
    assert once == form.canonical(whole)


def test_pairs_against_brute_force(spark, form):
    r = random.Random(5)
    forms = ["ann", "аnn", "ａnn", "an­n", "Ann", "ánn", "bob", "ｂob", "", None]
    rows = [(i, r.choice(["http://a", "ｈttp://a", "http://b", None]), r.choice(forms)) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, "http://a", "аnn")], "id int, url string, name string").withColumns({"ka": F.lit("clash"), "h": F.lit("clash")})
    got = {(x.id_a, x.id_b) for x in lookalike.same_reading_pairs(df, "id", "url", "name").collect()}
    c = form.canonical
    want = {
        (a, b)
        for a, u, n in rows
        for b, v, m in rows
        if a < b and None not in (u, n, v, m) and (c(u), c(n)) == (c(v), c(m)) and (u, n) != (v, m)
    }
    assert got == want and want
    assert lookalike.same_reading_pairs(df.limit(0), "id", "url", "name").count() == 0
    links = {i: sum(i in p for p in want) for p in want for i in p}
    classes = {x.id: (x.class_id, x.n_links) for x in lookalike.same_reading_classes(df, "id", "url", "name").collect()}
    assert {i: n for i, (_, n) in classes.items()} == links
    assert all(classes[a][0] == classes[b][0] <= a for a, b in want) and lookalike.same_reading_classes(df.limit(0), "id", "url", "name").count() == 0


def test_pairs_of_many_copies(spark):
    # 200,000 copies of one spelling would make 2 * 10**10 comparisons among themselves
    many = spark.range(200_000).select("id", F.lit("http://a").alias("url"), F.lit("ann").alias("name"))
    one = spark.createDataFrame([(200_000, "http://a", "аnn")], "id bigint, url string, name string")
    got = lookalike.same_reading_pairs(many.unionByName(one), "id", "url", "name")
    assert got.agg(F.count(F.lit(1)), F.min("id_b"), F.countDistinct("id_a")).first() == (200_000, 200_000, 200_000)


# ---------------------------------------------------------------- leakage


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute(doc, item, window):
    a, b = words_of(doc), words_of(item)
    grams = {tuple(b[i : i + window]) for i in range(len(b) - window + 1)}
    return any(tuple(a[i : i + window]) in grams for i in range(len(a) - window + 1))


WORDS = st.sampled_from(["a", "b", "c", "d", "é", "漢字", "x1", "B"])


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=60), max_size=4), st.lists(st.lists(WORDS, max_size=12), min_size=1, max_size=4), st.integers(2, 5), st.sampled_from([" ", "_", "\r\n+# "]))
def test_search_against_brute_force(docs, items, window, between):
    docs, items = [between.join(d) for d in docs], [(i, " ".join(x)) for i, x in enumerate(items)]
    engine = leakage.WuManber([(i, t.lower()) for i, t in items], window)
    assert engine.search_all([d.lower() for d in docs]) == [{i for i, t in items if brute(d, t, window)} for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_words_are_those_of_the_pattern(text):
    text = text.lower()
    _, begin, end = leakage.word_hashes(text)
    assert [text[b:e] for b, e in zip(begin, end, strict=True)] == words_of(text)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(leakage, "PIECE", 50)
    monkeypatch.setattr(leakage, "STRETCH", 4)
    r = random.Random(2)
    docs = [" ".join(r.choice("abc") * r.choice([1, 1, 1, 70]) for _ in range(n)) for n in (0, 3, 40, 300, 5, 90)]
    items = [(i, " ".join(r.choice("abc") for _ in range(9))) for i in range(6)]
    assert leakage.WuManber(items, 4).search_all(docs) == [{i for i, t in items if brute(d, t, 4)} for d in docs]


def test_an_item_longer_than_a_block(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    docs = [(k, " ".join(words[k : k + 13])) for k in range(188)] + [(188, " ".join(words)), (189, " ".join(words[5:17])), (190, "x")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    assert sorted(tuple(x) for x in leakage.leaks(d, i, block_words=40).collect()) == [(k, 1) for k in range(189)]


def test_leaks(spark):
    item = "If no lattice fits the mossy notebook, the ferry swaps an aqueduct instead of it."
    words = item.split()
    docs = [
        (1, "+# If no LATTICE\r\n+# fits the mossy--notebook, the ferry\n-swaps an aqueduct // instead"),
        (2, " ".join(words[1:13])),
        (3, " ".join(words[1:14])),
        (4, None), (5, ""), (6, "x " * 50_000 + item), (7, item.replace("mossy", "old")), (3, item), (None, item),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame([(10, item), (11, item), (12, "too short"), (13, None), (None, item)], "item_id bigint, text string")
    got = sorted((x.doc_id, x.item_id) for x in leakage.leaks(d, i).collect())
    assert got == sorted((a, b) for a in (1, 3, 3, 6) for b in (10, 11))
    # the items in several blocks find the same
    assert sorted((x.doc_id, x.item_id) for x in leakage.leaks(d, i, block_words=14).collect()) == got
    assert leakage.leaks(d, i.limit(0)).count() == 0 and leakage.leaks(d.limit(0), i).count() == 0


# ---------------------------------------------------------------- personal data

GOOD = [
    ("Author: Søren Velm <svelm@box.example>", {("name", "Søren Velm"), ("email", "svelm@box.example")}),
    ("Mail viktor_m at post dot test if this breaks.", {("email", "viktor_m at post dot test")}),
    ("git remote add up git@forge.example:a/b.git", set()),
    ("amqp://svc:34c5@queue.example:5672/q", set()),
    ("header-utils@1.94.2", set()),
    ("Call +44 7700 900123 when the job hangs.", {("phone", "+44 7700 900123")}),
    ('    "phone": "(312) 555-0198",', {("phone", "(312) 555-0198")}),
    ("Rückruf unter 0049 (0)30 23125-359.", {("phone", "0049 (0)30 23125-359")}),
    ("Tel. 030/23125899", {("phone", "030/23125899")}),
    ("checksum 577 801 8451", set()),
    ("part no. 371-91-8598", set()),
    ("The failing row was the customer with SSN 918-48-6890.", {("id_number", "918-48-6890")}),
    ("El DNI 19779761I se rechaza.", {("id_number", "19779761I")}),
    ("Le numéro de sécurité sociale 3 72 23 99 849 608 34 est refusé.", {("id_number", "3 72 23 99 849 608 34")}),
    ("Parcel goes to Flat 4, 97a Tolvar Street, Port Haldane 31785.", {("address", "Flat 4, 97a Tolvar Street, Port Haldane 31785")}),
    ("Colis pour 235, rue des Tilvères, Saint-Quelbert.", {("address", "235, rue des Tilvères, Saint-Quelbert")}),
    ("Lieferung an Lindholzweg 93, 18292 Quellau.", {("address", "Lindholzweg 93, 18292 Quellau")}),
    ("Entrega en Avda. de Torvela, 35, 4.º B, San Lureno.", {("address", "Avda. de Torvela, 35, 4.º B, San Lureno")}),
    ("Lane 49 of the retry router", set()),
    ("Spoke with Greta Z. Zanville about it.", {("name", "Greta Z. Zanville")}),
    ("Rücksprache mit Frau Pelvier, Viktor nötig.", {("name", "Pelvier, Viktor")}),
    ('release "Velvet Otter" 3.59.6', set()),
    ("From: dep-updater[bot] <bot@forge.example>", {("email", "bot@forge.example")}),
    ("Questions to lnul (at) vuwopost.com.example.", {("email", "lnul (at) vuwopost.com.example")}),
    ("El DNI 19779761Ñ se rechaza.", {("id_number", "19779761Ñ")}),
    ("Author: Иван Петров <ipetrov@box.example>", {("name", "Иван Петров"), ("email", "ipetrov@box.example")}),
]


def test_personal_data(spark):
    rows = [(i * 100 + k, f"intro\n{t}\r\nend") for i, (t, _) in enumerate(GOOD) for k in range(8)] + [(None, "Mail a.b@c.example"), (2**60 + 1, "plain"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "x y\n" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("pii_type", F.lit("clash"))
    found = {}
    for r in pii.find_personal(df).collect():
        found.setdefault(r.doc_id, set()).add((r.pii_type, r.pii_text))
    for i, (text, want) in enumerate(GOOD):
        assert found.get(i * 100, set()) == want, text
    assert not any(d is None or d >= 10**6 for d in found)
    redacted = {r.doc_id: (r.redacted, r.n_spans) for r in pii.redact(df).collect()}
    assert redacted[500] == ("intro\nCall [PHONE] when the job hangs.\r\nend", 1)
    assert redacted[None] == ("Mail [EMAIL]", 1) and redacted[2**60 + 1] == ("plain", 0)
    assert redacted[10**6] == (None, 0) and redacted[10**6 + 1] == ("", 0)
    for i, (text, want) in enumerate(GOOD):
        out = redacted[i * 100][0]
        assert re.sub(r"\[[A-Z_]+\]", "", out).count("\n") == 2 and not any(t in out for _, t in want)
    assert pii.find_personal(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_equal_spans_once_and_long_text(spark):
    text = ("padding line\n" * 20_000) + "Mail a.b@c.example\nMail a.b@c.example\n"
    df = spark.createDataFrame([(1, text), (2, "Mail a.b@c.example")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in pii.find_personal(df).collect()) == [(1, "email", "a.b@c.example"), (2, "email", "a.b@c.example")]


def test_addresses_of_several_formats_in_a_line():
    ways = ["12 Oak Street, Pelham", "Lindenstrasse 4, 10115 Berlin", "8 rue de la Paix, 75002 Paris", "Calle Mayor 3, 28013 Madrid"]
    for line in (" | ".join(ways), "; ".join(reversed(ways)), "x\n" + " / ".join(ways[1:]) + "\ny"):
        spans = sorted((b, e) for b, e, kind, _ in pii.candidates(line) if kind == "address")
        assert {line[b:e] for b, e in spans} == {w for w in ways if w in line}
        assert all(e <= b for (_, e), (b, _) in zip(spans, spans[1:]))


def test_address_in_a_long_line_with_few_blanks():
    fields = ",".join(f'"field{i}":"{i:x}value{i}"' for i in range(250))
    line = "{" + fields + ',"ship_to":"12 Long Street, Newtown 12345","contact":"Anna Velm","mail":"a.velm@box.example",' + fields + "}"
    assert len(line) > 10_000 and line.count(" ") < 6
    spans = {(kind, line[b:e]): votes for b, e, kind, votes in pii.candidates(line)}
    assert ("address", "12 Long Street, Newtown 12345") in spans and min(spans["address", "12 Long Street, Newtown 12345"]) >= 0
    assert min(spans["name", "Anna Velm"]) >= 0 and min(spans["email", "a.velm@box.example"]) >= 0


def test_reliabilities_are_learnt():
    """A labeler that says the opposite of the others, and one that guesses, lose or turn their weight."""
    r = random.Random(4)
    true = [r.random() < 0.4 for _ in range(20_000)]
    votes = [[(1 if r.random() < 0.9 else -1) * (1 if y else -1) for _ in range(4)] + [r.choice((-1, 0, 1)), (-1 if y else 1)] for y in true]
    patterns, counts = pii.np.unique([pii._encode(v) for v in votes], return_counts=True)
    posterior, answers, share = pii.reliabilities(patterns, counts.astype(float))
    known = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    right = sum((known[pii._encode(v)] >= 0.5) == y for v, y in zip(votes, true, strict=True))
    assert right > 0.99 * len(true) and abs(share - 0.4) < 0.03
    assert abs(pii.np.log(answers[0, 4, 2] / answers[1, 4, 2])) < 0.2 and answers[0, 5, 2] < 0.1 < answers[1, 5, 2]


def test_labelers(spark):
    df = spark.createDataFrame([(i, "Mail a.b@c.example or call +44 7700 900123") for i in range(20)], "doc_id bigint, text string")
    rows = pii.labelers(df).collect()
    assert len(rows) == 2 * 6 * 3 and {x.pii_type for x in rows} == {"email", "phone"}
    assert pii.labelers(df.limit(0)).count() == 0
