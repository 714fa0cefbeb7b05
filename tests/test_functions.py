import html

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom.functions import clock, plain, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([Row(i=i, x=x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_columns(spark):
    assert column(spark, ["a​bㅤc️", None], text.clean_invisible) == ["ab c", ""]
    assert column(spark, ["[Context: x]\nBody", "Body [Context: x]"], text.without_context) == ["Body", "Body [Context: x]"]
    assert column(spark, ["[Image: a b]\nText", "[Context: q]\n[Forwarded from X] [Image: a]\nText"], text.without_image_note) == ["Text", "[Context: q]\n[Forwarded from X] Text"]
    assert column(spark, ["[Photo] Hi", "[gif]Hi", "[Other] Hi"], text.without_media_prefix) == ["Hi", "Hi", "[Other] Hi"]
    long = "Слово é " * 20
    assert column(spark, [long, "short"], text.repost_key) == ["словоé" * 20, ""]
    assert column(spark, ["x" * 149, "x" * 150, "[a] [b] " + "y" * 310 + " https://e.org/" + "z" * 400, None], text.richness) == [0, 1, 2, 0]
    assert column(spark, ["Points: 590 # Comments: 284", "Points:7", "no", None], text.votes) == [590, 7, None, None]
    assert column(spark, ["https://t.me/name/12", "https://t.me/c/123/4", "https://t.me/+x"], lambda c: F.concat_ws(" ", text.post_link(c)[0], text.post_link(c)[1].cast("string"))) == ["name 12", "123 4", ""]
    assert column(spark, ["@chan", "-100123", "", None, "https://t.me/x"], lambda c: text.source_link(F.lit("telegram"), c)) == ["https://t.me/chan", None, None, None, "https://t.me/x"]
    assert column(spark, ["ß Straße\n x", "A  B"], text.normal_for_rules) == ["ss strasse x", "a b"]
    assert column(spark, ["1 000 and 2,500.5 and 7"], text.numbers) == [["1000", "2500.5", "7"]]
    assert column(spark, ["привіт їжак", "привет ёжик", "abcdef", "ok"], lambda c: text.reads_as(c, "Ѐ-ӿ", "іїєґ", "ыэъё")) == [True, False, False, True]
    assert column(spark, ["s", "s …", "s "], lambda c: text.mark_cut(c, F.lit("y" * 701))) == ["s …", "s …", "s …"]


def test_compose(spark):
    df = spark.createDataFrame([("T", "Body", "T. Body"), ("Title", "the title is in", "the title is in"), ("All of it", "of", "All of it"), (None, " b ", "b"), ("a", None, "a")], "t string, b string, e string")
    assert all(r.c == r.e for r in df.withColumn("c", text.compose(F.col("t"), F.col("b"))).collect())


def test_page_leads(spark):
    own = "A sentence of a page about itself that is long enough to count as one."
    para = "A paragraph with more than eighty characters, so that it counts as one that says something."
    pages = [
        f'<meta property="og:description" content="{own}"><p>{para}</p>', f"<meta name='description' content='short'><p>{para}</p><p>x</p><p class=a>{para}</p><p>{para}</p>",
        f"<nav><p>{para}</p></nav><path>{para}</path>", f'<meta content="{own}" property="og:description">', f"<p>{para[:40]}<b>{para[40:]}</b> &amp; more</p>",
    ]
    assert column(spark, pages, text.lead) == [own, f"{para} {para}", "", own, f"{para[:40]} {para[40:]} & more"]
    assert column(spark, ["<p>a &lt;b&gt;</p>\n c"], text.strip_html) == [" ".join(html.unescape("a").split()) + " c"]


def test_clock(spark):
    assert column(spark, ["11:00, 16:00", "25:99,12:00", "", None, "7:5,x"], clock.parse_times) == [[660, 960], [720], [], [], [425]]
    assert column(spark, [None, 0.001, 0.5, 6.9, 47.9, 48.0, 264.0], clock.ago, "double") == ["never", "1m ago", "30m ago", "6h ago", "47h ago", "2d ago", "11d ago"]
    assert column(spark, [1, 0], lambda c: clock.shifted(c, -2), "int") == [1439, 1438]


def test_facts():
    bad = lambda s, t: plain.unsupported(s, t, 2026)
    assert bad("It cost 37 million", "it cost a lot") == ["37"]
    assert bad("It cost $80K", "for 80,000 dollars") == [] and bad("80,000", "$80K") == []
    assert bad("1,8 млн", "300 тис і 500 тис та 1 млн") == [] and bad("491 грн", "500 грн, а 9 менше") == []
    assert bad("in 2024", "2026 and 2") == ["2024"] and bad("in 2025", "x") == []
    assert bad("Helped Ukraine", "Help came") == ["Україна"]
    assert bad("Прем'єр Шмигаль сказав", "Сказав прем'єр, що все буде добре, Денис Шмигаль") == []
    assert bad("Сказав пан Орбан", "Сказав пан Мадяр, що все буде добре у країні") == ["Орбан"]
    assert plain.skeleton("Johnson") == plain.skeleton("Джонсон") and plain.skeleton("Zagreb") == plain.skeleton("Загребі")


def test_answers():
    assert plain.repaired_json('{"a": "x "y" z"}') == {"a": 'x "y" z'}
    assert plain.repaired_json('[{"id": 1}]', "items") == {"items": [{"id": 1}]} and plain.repaired_json("[1]") is None and plain.repaired_json(None) is None
    assert plain.repaired_json(r'{"a": "b\"c"}') == {"a": 'b"c'}
    assert plain.wait_seconds("2m59.56s") == pytest.approx(179.56) and plain.wait_seconds("1h30m") == 5400 and plain.wait_seconds("15") == 15 and plain.wait_seconds("") is None and plain.wait_seconds("0s") is None
    assert plain.retry_after({"retry-after": "3", "x-ratelimit-reset-tokens": "60s"}) == 3 and plain.retry_after({"x-ratelimit-reset-tokens": "1m", "x-ratelimit-reset-tokens-minute": "2s"}) == 60 and plain.retry_after({}) is None


@pytest.mark.parametrize(("given", "expected"), [
    ("https://t.me/name/123", ("@name", "telegram")), ("t.me/s/name", ("@name", "telegram")), ("https://t.me/c/123/4", ("-100123", "telegram")), ("https://t.me/+abc", ("https://t.me/+abc", "telegram")),
    ("t.me/s", ("t.me/s", "telegram")), ("@name", ("@name", "telegram")), ("name", ("@name", "telegram")), ("-100123", ("-100123", "telegram")), ("https://e.org/feed", ("https://e.org/feed", "rss")),
])
def test_source_input(given, expected):
    assert plain.source_input(given) == expected


def test_lines():
    span = lambda t, p: t[slice(*plain.anchor(t, p))]
    assert span("Fed raises rates again", "raises rates") == "raises rates"
    assert span("Fed cut", "Fed") == "Fed cut"
    assert span("У Полтаві чутно вибухи", "вибух в Полтаві").startswith("Полтаві")
    assert span("Kyiv Council adopts budget", None) == "adopts"
    assert plain.rule_title("= Licensed") == "= exact phrases" and plain.rule_title("Adverts") == "Adverts" and plain.rule_title(": Adverts: shops, sales") == "Adverts…"
    assert plain.rule_title("Posts that ask the reader to subscribe to a channel") == "Posts that ask the reader to subscribe…" and len(plain.rule_title("word " * 30)) <= 46
    assert plain.image_note("a [b]\n c") == "[Image: a (b) c]" and plain.image_note(" ") == ""
    assert plain.without_feed_footer("T (x)", "Body.\nThe post T (x) appeared first on Site.") == "Body." and plain.without_feed_footer("T", "The post office first appeared on stamps.") == "The post office first appeared on stamps."


@pytest.mark.parametrize(("summary", "source", "found"), [
    # figures in any writing
    ("Costs 12 500", "It costs 12,500 now", []), ("Costs 12500", "costs 12.500 eura", []), ("Costs 12 501", "costs 12,500", ["12501"]), ("Rose 2,5 млн", "rose by 2.5 million", []), ("Met on 7 May", "on 07.05 in town", []),
    # number words, scales, halves, shares
    ("7 people", "seven people", []), ("7 people", "seventh heaven, sevenfold", []), ("9 people", "canine nineveh", []), ("6000 trips", "six thousand trips", []), ("3,5 years", "three and a half years", []), ("25 %", "a quarter of all", []), ("33 %", "a third of it", []), ("50 %", "on behalf of all", ["50"]),
    # sums and differences
    ("5 hurt", "two hurt there, three here", []), ("700 in all", "300, 250 and 150", []), ("400 left", "of 900 some 500 went", []), ("701 in all", "300, 250 and 150", ["701"]), ("8 hurt", "four hurt there, four here", []), ("8 hurt", "four hurt there", ["8"]),
    ("11 hurt", "10 hurt, one of them a child", ["11"]), ("10 hurt", "9 hurt, one more later", []), ("in 2021", "in 2023, 2 years", ["2021"]), ("1300 coins", "0xab12cd34 sent 600 https://e.org/900000 and 700", []),
    # years around the present, and nothing twice
    ("in 2025 and 2027", "soon", []), ("1998, again 1998", "long ago", ["1998"]), ("", "", []), ("a …", "b", []),
])
def test_figures_of_a_summary(summary, source, found):
    assert plain.unsupported(summary, source, 2026) == found


def test_sounds_of_names():
    for a, b in [("Мюллер", "Müller"), ("Філіп", "Philip"), ("Хвар", "Hvar"), ("Гаага", "Haag"), ("Джокер", "Joker"), ("Шахтар", "Shakhtar")]:
        assert plain.skeleton(a) == plain.skeleton(b), (a, b)
    assert plain.skeleton("") == "" and plain.skeleton("аеіо") == "" and len(plain.skeleton("Szczebrzeszyn")) == 3


def test_mended_answers():
    assert plain.repaired_json('{"a": "said "no" and "yes"", "b": ["x "y"", "z"]}') == {"a": 'said "no" and "yes"', "b": ['x "y"', "z"]}
    assert plain.repaired_json('{"a": "open') is None and plain.repaired_json('[{"t": "a "b" c"}]', "items") == {"items": [{"t": 'a "b" c'}]}


def test_quotes_of_what_is_answered():
    assert plain.reply_quote("One two - three four five six seven", None) == "One two - three four five six…"
    assert plain.reply_quote(" ", "[Context: a]\n[Forwarded from B] First line\nsecond") == "First line"
    assert plain.reply_quote("[Photo] A caption", None) == "A caption" and plain.reply_quote("[Photo]", None) == "📷 Photo" and plain.reply_quote("[Media]", None) == ""
    assert plain.reply_quote(None, None) == ""


def test_labels(spark):
    assert column(spark, ["short", "a label of very many words that goes on and on", "x" * 50, None], text.clipped) == ["short", "a label of very many words that goes…", "x" * 39 + "…", None]
    assert column(spark, ["a:b:3", "a:b", "a:", "7"], lambda c: F.concat_ws("|", *text.name_and_page(c))) == ["a:b|3", "a:b|0", "a:|0", "7|0"]
