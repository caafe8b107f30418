import random
import re

from pyspark.sql import functions as F

from catalake.functions import price as P
from catalake.functions import sku as S
from catalake.functions import text as X
from catalake.functions import url as U


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_price_numbers(spark):
    assert values(spark, ["$1,234.50", "", "abc", "1.2.3", ".", "5.", ".5", "-12.5", "1.50 - 2.00", None], P.to_number) == [1234.5, 0, 0, None, None, 5, 0.5, 12.5, None, 0]
    assert values(spark, ["", "7"], lambda c: P.to_number(c, None)) == [None, 7]


def test_percentages(spark):
    pairs = spark.createDataFrame([(100.0, 80.0), (100.0, 100.0), (100.0, 99.6), (0.0, 1.0), (80.0, 100.0)], "o double, n double")
    o, n = F.col("o"), F.col("n")
    got = pairs.select(P.percent_off(o, n).alias("a"), P.percent_off(o, n, "zero").alias("b"), P.percent_off(o, n, "null_if_zero").alias("c"), P.percent_change(o, n).alias("d")).collect()
    assert [tuple(r) for r in got] == [(20, 20, 20, -20), (None, 0, None, 0), (0, 0, None, 0), (None, 0, None, None), (None, 0, None, 25)]


def test_money_text(spark):
    rows = spark.createDataFrame([("11035", 2), ("5", 2), ("0", 0), ("12", 0), ("x", 2), (None, 2), ("1234567", 6)], "v string, u int")
    assert [r[0] for r in rows.select(P.from_minor_units(F.col("v"), F.col("u"))).collect()] == ["110.35", "0.05", "0", "12", "", "", "1.234567"]
    assert values(spark, ["1234.5", "0.05", None], lambda c: P.to_text(c.cast("double"))) == ["$1234.50", "$0.05", ""]
    assert values(spark, ["1234.5"], lambda c: P.to_text(c.cast("double"), True)) == ["$1,234.50"]
    assert values(spark, ["was $1,020.00 now", "none"], P.first_amount) == ["1020.00", ""]


def test_six_digits(spark):
    texts = ["SKU 123456", "1234567", "x123456", "a_123456", "u:12345678", "123456 654321", "é123456", None]
    assert values(spark, texts, S.six_digits) == ["123456", "", "", "", "", "123456", "123456", ""]


def test_fnv(spark):
    def brute(t):
        h = 0x811C9DC5
        b = t.encode("utf-16-be", "surrogatepass")
        for i in range(0, len(b), 2):
            h = ((h ^ int.from_bytes(b[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    random.seed(1)
    texts = ["", "A|b", "BCL|https://x.com/a", "é\U0001f600"] + ["".join(random.choice("aé中\U0001f600z|/ ") for _ in range(random.randrange(20))) for _ in range(50)]
    assert values(spark, texts, S.fnv1a) == [brute(t) for t in texts]
    assert values(spark, texts[:3], S.fnv1a) == ["811c9dc5", "8bd8a876", "00ff7ed0"]


def test_keys(spark):
    rows = spark.createDataFrame([("123456", "s", "http://u"), ("u:abc", "s", "http://u"), ("", "s", "http://u"), ("x", "s", "")], "v string, s string, u string")
    v, s, u = F.col("v"), F.col("s"), F.col("u")
    got = [tuple(r) for r in rows.select(S.stored_key(v, s, u), S.diff_key(v, s, u), S.raw_key(v, s, u)).collect()]
    made = got[2][0]
    assert got == [("123456",) * 3, ("u:abc", made, "u:abc"), (made, made, made), ("", "", "x")] and made.startswith("u:")
    pairs = spark.createDataFrame([("b", "a"), ("a", "a"), ("", "a"), (" c", "a")], "a string, b string")
    assert [tuple(r) for r in pairs.select(S.pair_key(F.col("a"), F.col("b")), S.pair_key(F.col("a"), F.col("b"), True)).collect()] == [("a|b", "b|a"), ("", ""), ("", ""), ("a|c", "c|a")]


def test_text(spark):
    assert values(spark, ["&amp;lt;", "&#39;", "&nbsp;", "&#65;&#x42;c&#xE9;", None], X.decode_entities) == ["<", "'", " ", "ABcé", ""]
    assert values(spark, ["<b>a</b> <i>b</i>\n c"], X.clean) == ["a b c"]
    assert values(spark, ['O\'Brien "12" – Réserve & Co.'], X.sanitize_name) == ["OBrien 12 Réserve & Co."]
    assert values(spark, ['<a href="x" class=y>', "<a class='z'>", "<a>"], lambda c: X.attribute(c, "class")) == ["y", "z", ""]
    assert values(spark, ["Bowmore Sherry", "bow"], lambda c: X.matches_all(X.search_norm(c), ["bow", "she"])) == [True, False]
    assert values(spark, ["SMWS 12.345 x", "12.345"], X.code_key) == ["12.345", ""]


def test_similarity_is_symmetric_and_penalises_numbers(spark):
    names = ["glen moray 12 sherry", "glen moray 18 sherry", "glen moray 12 port", "ardbeg ten", ""]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    ta, tb = X.similarity_tokens(F.col("a")), X.similarity_tokens(F.col("b"))
    got = {(r["a"], r["b"]): r["s"] for r in rows.select("a", "b", X.similarity(F.col("a"), F.col("b"), ta, tb).alias("s")).collect()}
    assert all(abs(got[a, b] - got[b, a]) < 1e-12 for a, b in got)
    assert got[names[0], names[2]] > got[names[0], names[1]] and got[names[0], names[4]] == 0
    assert abs(got[names[0], names[0]] - (3 + 2.2 + 1)) < 1e-9


def test_urls(spark):
    texts = ["http://a.b/c/page/3/?page=2&x=1#h", "https://a.b", "not a url", "http://a.b/c?page=2"]
    assert values(spark, texts, U.normalize_base) == ["http://a.b/c/?x=1", "https://a.b/", "not a url", "http://a.b/c/"]
    assert values(spark, ["/x", "//y.z/a", "q", "http://w/", ""], lambda c: U.resolve(c, F.lit("https://h.i/j/k?l"))) == ["https://h.i/x", "https://y.z/a", "https://h.i/j/q", "http://w/", ""]
    assert values(spark, ["a b/c"], U.encode) == ["a%20b%2Fc"]
    assert re.fullmatch(r"a__b__[0-9a-f]{8}\.json", values(spark, ["a"], lambda c: S.file_id(c, F.lit("b"), F.lit("http://x")))[0])


def test_clamped_and_padded(spark):
    assert values(spark, [" 42px", "-3", "9" * 30, "", "x1", None, "+7"], lambda c: P.clamped(c, 5, 0, 100)) == [42, 0, 100, 5, 5, 5, 7]
    assert values(spark, ["x", None], lambda c: P.clamped(c, None, 0, 100)) == [None, None]
    assert values(spark, ["ab", "abcdef", "", "é"], lambda c: X.padded(c, 4)) == ["ab  ", "abcdef", "    ", "é   "]
    assert values(spark, ["ab", "abcdef"], lambda c: X.padded(c, 4, left=True)) == ["  ab", "abcdef"]


def test_page_parameter_and_api(spark):
    at = lambda page, name: lambda c: U.page_by_parameter(c, F.lit(page), name)
    assert values(spark, ["http://h/c", "http://h/c/?x=1&pg=2&y=3&pg=4", "http://h/c/?pgs=1"], at(7, "pg")) == ["http://h/c/?pg=7", "http://h/c/?x=1&pg=7&y=3", "http://h/c/?pgs=1&pg=7"]
    assert values(spark, ["http://h/c/?page=9&a=b#t"], at(0, "page")) == ["http://h/c/?a=b&page=1"]
    api = "https://h.example/wp-json/wc/store/v1/products?order=desc&orderby=date"
    urls = ["https://h.example/w/", "https://h.example/w/?_sfm__stock_status=instock&_sfm__regular_price=0+600", "https://h.example/w/?_sfm__regular_price=5%2B600", "https://h.example/w/?_sfm__stock_status=%zz"]
    # A plain plus sign is a space in a query, which gives no span.
    assert values(spark, urls, U.store_api) == [api, f"{api}&stock_status=instock", f"{api}&min_price=5&max_price=600", api]
