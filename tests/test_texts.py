from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import rates, trusted
from riskloom.operators.lexicon import intent_scores


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(make(F.col("x")).alias("y")).first()["y"]


def test_slang_whole_word_longest_first_and_case(spark):
    slang = {"mk": "mật khẩu", "share mk": "chia sẻ mật khẩu", "ko": "không"}
    assert one(spark, "Share MK di, ko thi thoi", lambda c: tx.expand_slang(c, slang)) == "chia sẻ mật khẩu di, không thi thoi"
    assert one(spark, "remko mkb", lambda c: tx.expand_slang(c, slang)) == "remko mkb"
    assert one(spark, None, lambda c: tx.expand_slang(c, slang)) is None
    assert one(spark, "", lambda c: tx.expand_slang(c, slang)) == ""


def test_high_risk_slang(spark):
    assert one(spark, "cho xin MK nhé", lambda c: tx.has_slang(c, ["mk", "pass"]))
    assert not one(spark, "passport", lambda c: tx.has_slang(c, ["mk", "pass"]))


def test_matching_form_drops_accents_and_wide_letters(spark):
    assert one(spark, "  Miễn PHÍ — Đưa 𝐟𝐫𝐞𝐞 ｇift!", tx.match_form) == "mien phi dua free gift"
    assert one(spark, "éa", tx.match_form) == "ea"


def test_compat_form(spark):
    assert one(spark, "Ａ(B)-c_d\n e", tx.compat_form) == "a b c d e"


def test_clean_text_entities_and_blanks(spark):
    assert one(spark, "a&amp;b&nbsp;​ c &#8364;", tx.clean_text) == "a&b c €"


def test_parse_number_styles(spark):
    cases = {"1.000.000": 1e6, "1,5": 1.5, "1.234,56": 1234.56, "1,234.56": 1234.56, "12": 12.0, "1.5": 1.5, "1,000": 1000.0, "x": None, "": None}
    for raw, value in cases.items():
        assert one(spark, raw, tx.parse_number) == value, raw


def test_parse_number_round_trip(spark):
    df = spark.range(1, 2000, 7).select((F.col("id") * 1013).alias("v"))
    bad = df.filter(tx.parse_number(F.format_number("v", 0)) != F.col("v").cast("double"))
    assert bad.count() == 0


def test_mentions_positions_match_python(spark):
    import re

    text = "bán 1.000 robux giá 50k, 20 kim cương = 5 vnd và 7kc, 3 rbxx"
    units = ["k", "vnd", "robux", "kim cương", "kc", "rbx"]
    rows = one(spark, text, lambda c: rates.mentions(c, units))
    number = r"(?:\d{1,3}(?:[\.,]\d{3})+|\d+(?:[\.,]\d+)?)"
    want = [(m.start(), m.group(1), m.group(2)) for m in re.finditer(
        rf"({number})\s*({'|'.join(sorted(map(re.escape, units), key=len, reverse=True))})\b", text)]
    assert [(r["pos"], r["raw"], r["unit"]) for r in rows] == want


def severities(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    bands = rates.band_table(spark)
    aliases = [r["alias"] for r in bands.select("alias").collect()]
    return [(r["currency"], r["severity"]) for r in rates.rate_hits(rates.rate_pairs(df, "id", "t", aliases), bands).collect()]


def test_rate_bands(spark):
    assert severities(spark, "100k được 300 robux") == []
    assert severities(spark, "100k được 700 robux") == [("robux", "suspicious")]
    assert severities(spark, "100k được 1.000 robux") == [("robux", "scam")]
    assert severities(spark, "100k " + "-" * 95 + " được 1.000 robux") == []
    assert sorted(severities(spark, "100.000 vnd = 1000 robux hoặc 50 uc")) == [("robux", "scam")]
    assert severities(spark, "không có giá") == []


def test_severity_grows_with_amount(spark):
    order = {"none": 0, "suspicious": 1, "scam": 2}
    seen = [order[(severities(spark, f"100k nhận {n} uc") or [(0, "none")])[0][1]] for n in (100, 640, 660, 890, 910)]
    assert seen == sorted(seen) and seen[-1] == 2


def source(spark, text):
    return trusted.trusted_source(spark.createDataFrame([(text,)], "t string"), "t").first()


def test_trusted_source(spark):
    good = source(spark, "Nạp tại shop.vnggames.com qua webpay")
    assert good["safe_reference"] and good["safe_discount"] > 0 and good["trusted_hits"] >= 1
    bad = source(spark, "shop.vnggames.com nhưng gửi mật khẩu cho mình, chuyển khoản trước")
    assert bad["risky_prompt"] and bad["safe_discount"] == 0
    warned = source(spark, "Roblox VNG webpay: không đưa otp cho ai")
    assert not warned["risky_prompt"] and warned["safe_reference"]
    assert source(spark, "bài viết thường")["trusted_hits"] == 0


def test_intents_first_wins_ties_and_empty(spark):
    lexicon = [("a", 0.9, ["xx", "yy"]), ("b", 0.5, ["zz", "ww"])]
    df = spark.createDataFrame([("xx zz",), ("",), (None,)], "t string")
    rows = intent_scores(df, "t", lexicon).collect()
    assert [r["primary_intent"] for r in rows] == ["a", "none", "none"]
    assert rows[0]["max_intent_score"] == 1.0 and rows[0]["intent_count"] == 2


def test_fragment_and_word_dedup(spark):
    df = spark.createDataFrame([(["ab c", "b", "AB  c", "zz"],)], "p array<string>")
    assert tx.drop_contained(df, "p").first()["p"] == ["ab c", "zz"]
    words = spark.createDataFrame([("A b a B c",)], "t string")
    assert tx.distinct_words(words, "t").first()["t"] == "A b c"


def test_garbled_and_noise(spark):
    assert one(spark, "", tx.is_garbled) and one(spark, None, tx.is_garbled)
    assert not one(spark, "Ã" * 5, tx.is_garbled)
    assert one(spark, "Ã" * 30, tx.is_garbled)
    assert one(spark, "1.2K", tx.is_noise) and one(spark, "5 phút trước", tx.is_noise) and one(spark, "Haha", tx.is_noise)
    assert not one(spark, "xin chào các bạn", tx.is_noise)


def test_numbers_of_mentions_are_read_as_columns_are(spark):
    raws = ["1.000.000", "1,5", "1.234,56", "1,234.56", "12", "1.5", "1,000", "1.000,000.000", "0", "007", "1.0000", "82.500,87", "999,999"]
    df = spark.createDataFrame([(r,) for r in raws], "x string").select("x", tx.parse_number(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == {r: rates.number_of(r) for r in raws}


def test_pairs_of_mentions_leave_no_number_to_the_plan(spark):
    offers = spark.createDataFrame([(1, "5k nhận 1.000 robux, 0 vnd, 2,5 rbx"), (2, None)], "id long, text string")
    pairs = rates.rate_pairs(offers, "id", "text", ["robux", "rbx"], 80)
    assert sorted(map(tuple, pairs.collect())) == [(1, 0, 8, 5000.0, 1000.0, "robux"), (1, 0, 28, 5000.0, 2.5, "rbx")]
    # The text is read in the task; parsing in the plan repeated its regular expressions for every use of a number.
    assert "RLIKE" not in pairs._jdf.queryExecution().optimizedPlan().toString()
