import pytest
from pyspark.sql import functions as F

from epistola.functions import classify as K
from epistola.functions import html as H
from epistola.functions import text as X
from epistola.functions.porter import stem, tokens
from epistola.functions.scoring import engagement, suggestion
from epistola.schemas import DIRECTIONS, guarded


def values(spark, expr, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_addresses(spark):
    given = ["Jordan <Jordan@Partner.example.com>", "plain@x.org", "no address", None, "", '"Last, F" <a@b.c>', "<  x@y.z >", "a@b c@d"]
    assert values(spark, X.extract_address, given) == ["jordan@partner.example.com", "plain@x.org", None, None, None, "a@b.c", "x@y.z", "a@b"]
    assert values(spark, X.display_name, given) == ["Jordan", None, None, None, None, "Last, F", None, None]
    assert values(spark, X.host_of, ["a@b.C", "a@b@c.d", "x", "x@", None]) == ["b.c", "c.d", None, None, None]
    assert values(spark, X.split_recipients, ["a@b, ,c@d ", None]) == [["a@b", "c@d"], []]


@pytest.mark.parametrize(("host", "domain"), [
    ("email.silversea.com", "silversea.com"), ("bbc.co.uk", "bbc.co.uk"), ("news.bbc.co.uk", "bbc.co.uk"), ("lux.com.au", "lux.com.au"), ("A.B.Example.COM", "example.com"), ("x.y.com:8080", "y.com"),
    ("mail.x.org.", "x.org"), ("localhost", "localhost"), ("", None), (None, None), ("co.uk", "co.uk"), ("a..b.com", "b.com"),
])
def test_registrable_domain(spark, host, domain):
    assert values(spark, X.registrable_domain, [host]) == [domain]


def test_snippets_refs_and_dates(spark):
    assert values(spark, X.compact_snippet, ["  a \n b ", " \t", None, "x" * 161, "y" * 160]) == ["a b", None, None, "x" * 159 + "…", "y" * 160]
    assert values(spark, lambda c: X.parse_ref(c)["id"], ["a:b:c", ":x", "x:", "x", None]) == ["b:c", None, None, None, None]
    assert values(spark, X.iso_millis, [1_717_000_000_000, 1, None], "bigint") == ["2024-05-29T16:26:40.000Z", "1970-01-01T00:00:00.001Z", None]
    assert values(spark, lambda c: X.iso_day(c, "?"), [0, None], "bigint") == ["1970-01-01", "?"]
    assert values(spark, X.round_half_up, [1.005, -2.5, -0.125, 2.344], "double") == [1.0, -2.5, -0.12, 2.34]
    assert values(spark, X.json_strings, ['["a","b"]', "oops", None]) == [["a", "b"], [], []]
    assert values(spark, lambda c: X.edit_labels(c, F.array(F.lit("N")), F.array(F.lit("B"))), [["A", "B"], []], "array<string>") == [["A", "N"], ["N"]]


def test_classification(spark):
    given = [["CATEGORY_UPDATES", "CATEGORY_PERSONAL"], ["INBOX"], ["SENT"], [], ["INBOX", "CATEGORY_FORUMS"], ["CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL"]]
    assert values(spark, K.category, given, "array<string>") == ["personal", "primary", None, None, "forums", "social"]
    heads = [{"list-ID": ""}, {"List-Unsubscribe": None}, {"X": "y"}, {}, None, {"LIST-UNSUBSCRIBE": "<x>"}]
    assert values(spark, K.is_list, heads, "map<string,string>") == [True, False, False, False, False, True]
    own = F.array(F.lit("Al@Example.com"))
    assert values(spark, lambda c: K.direction(F.array(), c, own), ["Al <AL@example.com>", "x@y.z", None]) == ["sent", "received", "received"]


def test_html(spark):
    page = "<html><head><title>t</title></head><!-- c --><style>p{}</style><p>One&nbsp;&amp;&#38;lt;</p><br/>Two&zwnj;<script>x()</script><b>3</b></html>"
    assert values(spark, lambda c: H.normalize_whitespace(H.html_to_text(c)), [page, None]) == ["One &<\n\nTwo 3", None]
    assert values(spark, H.decode_quoted_printable, ["caf=C3=A9 a=\r\nb =FF", None]) == ["café ab �", None]
    assert values(spark, H.looks_quoted_printable, ["a=\nb", "=C3=A9", "a=3Db", "x"]) == [True, True, False, False]
    assert values(spark, H.strip_padding_entities, ["&amp;&zwnj;&#8203;&#x200b;a​&lt;"]) == ["&amp;a&lt;"]
    assert values(spark, H.decode_entities, ["&Dagger;&unknown;&#x41;&#1114112;"]) == ["†&unknown;A"]


def test_deboilerplate_and_distill(spark):
    given = ["Hi\n> old\nthere\nOn Tue, Jo wrote:\nold", "a\n-- \nsig", "b\nClick to UNSUBSCRIBE here\nc", "From: x\ny", "none"]
    assert values(spark, H.deboilerplate, given) == ["Hi\nthere", "a", "b", "", "none"]
    assert values(spark, lambda c: H.distill(c, F.lit("<p>html</p>")), ["plain &amp; <tag>", " ", None]) == ["plain &amp; <tag>", "html", "html"]
    assert values(spark, H.meaningful_length, ["a b&nbsp;​c", None, ""]) == [3, 0, 0]


def test_images(spark):
    html = """<a href="https://s/x?a=1&amp;b=2"><img src='hero.jpg' width="600" height="300" alt="Deal"></a><img src="t.gif" width="1" height="1"><img width=5>
    <img src="hero.jpg" width=600 height=300><img src="line.png" width="600" height="4"><img src="photo.jpg" style="height: 64px; width:50px">"""
    got = values(spark, lambda c: H.classify_images(H.parse_images(c)), [html])[0]
    assert [(x["src"], x["kind"], x["score"], x["linkedHref"]) for x in got] == [
        ("hero.jpg", "content", 580, "https://s/x?a=1&b=2"), ("t.gif", "pixel", 0, None), ("hero.jpg", "content", 480, None), ("line.png", "divider", 0, None), ("photo.jpg", "icon", 0, None),
    ]
    best = values(spark, lambda c: H.ocr_candidates(H.classify_images(H.parse_images(c))), [html, ""])
    assert [x["src"] for x in best[0]] == ["hero.jpg"] and best[1] == []


@pytest.mark.parametrize(("word", "out"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"),
    ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("invoices", "invoic"), ("sky", "sky"), ("is", "is"),
])
def test_porter(word, out):
    assert stem(word) == out


def test_tokens():
    assert tokens("Café-Flights, 2 x_y") == ["cafe", "flight", "2", "x", "y"]
    assert tokens(None) == []


def test_scores(spark):
    now = 1_781_481_600_000
    base = {"msgs_received": 1, "msgs_sent": 0, "read_count": 1, "replied_count": 0, "initiated_count": 0, "starred_count": 0, "important_count": 0, "bulk_count": 0, "last_seen": now}
    rows = [base, base | {"replied_count": 3}, base | {"read_count": 0}, base | {"bulk_count": 1}, base | {"last_seen": now - 60 * 86_400_000}, base | {"last_seen": None}]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{k} bigint" for k in base))
    s = [r["s"] for r in df.select("i", engagement(now).alias("s")).orderBy("i").collect()]
    volume = 0.5 / 11
    assert s == pytest.approx([1.5 + volume, 3.0 + volume, -2.0 + volume, -0.5 + volume, 1.5 + volume / 2, 1.5])
    flat = [(2.0, True), (1.9, False), (0.0, True), (-0.5, False), (None, False)]
    df = spark.createDataFrame(flat, "s double, l boolean")
    assert [r[0] for r in df.select(suggestion(F.col("s"), F.col("l"))).collect()] == ["important", "none", "muted", "muted", "none"]


def test_guard(spark):
    assert values(spark, lambda c: guarded(c, DIRECTIONS, "direction"), ["sent", None]) == ["sent", None]
    with pytest.raises(Exception, match="direction is none of"):
        values(spark, lambda c: guarded(c, DIRECTIONS, "direction"), ["up"])
