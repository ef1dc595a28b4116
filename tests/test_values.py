"""Corner cases on literal rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from govspark.functions import amounts, classify, coerce, documents, keys, links
from govspark.functions import predicates as p
from govspark.functions import text as t
from govspark.operators import union
from govspark.operators.profile import role_of


def one(spark, column, **values):
    """Value of one expression over one literal row."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("amount", "asset", "formatted", "display"),
    [
        ("1234567.891", "1984", "1.23", "1.23 USDT"),
        ("1234567000000", "1337.0", "1,234,567.00", "1,234,567.00 USDC"),
        ("5000", "30", "5.00", "5.00 DED"),
        ("1234.5", None, "1,234.50", "1,234.50 DOT"),
        ("1234.5", "7", "1,234.50", "1,234.50 (Asset ID: 7)"),
        ("1234.5", "NaN", "1,234.50", "1,234.50 DOT"),
        ("NaN", "30", None, None),
        ("words", "30", None, None),
        (None, "30", None, None),
    ],
)
def test_amounts(spark, amount, asset, formatted, display):
    df = spark.createDataFrame([(amount, asset)], "amount string, asset string")
    row = amounts.with_display(df, "amount", "asset").first()
    assert (row["amount_formatted"], row["amount_display"]) == (formatted, display)


@pytest.mark.parametrize(
    ("balance", "lock", "weighted"),
    [("100", "0", 10.0), ("100", "1", 100.0), ("100", "6", 600.0), ("x", "1", None), ("100", None, None), (None, "1", None)],
)
def test_conviction(spark, balance, lock, weighted):
    df = spark.createDataFrame([(balance, lock)], "b string, l string")
    got = df.select(amounts.conviction_weighted(F.col("b"), F.col("l")).alias("x")).first()["x"]
    assert got == weighted if weighted is None else math.isclose(got, weighted)


def test_units_are_exact(spark):
    assert str(one(spark, amounts.remove_zeros(F.lit("2955235968346605113")))).rstrip("0") == "2955235968.346605113"
    assert str(one(spark, amounts.remove_zeros(F.lit("-" + "7" * 38)))) == "-" + "7" * 29 + "." + "7" * 9
    assert str(one(spark, amounts.remove_zeros(F.lit("5")))) == "5E-9" or one(spark, amounts.remove_zeros(F.lit("5"))) * 10**9 == 5
    assert one(spark, amounts.remove_zeros(F.lit("x"))) is None


@pytest.mark.parametrize(
    ("raw", "boolean", "integer", "number"),
    [
        ("Yes", True, None, None), (" f ", False, None, None), ("1", True, 1, 1.0), ("12.9", None, 12, 12.9),
        ("-12.9", None, -12, -12.9), ("NaN", None, None, None), ("", None, None, None), ("maybe", None, None, None),
        ("2955235968346605113", None, 2955235968346605113, 2955235968346605113.0),
        ("9" * 38, None, 10**38 - 1, 1e38), ("1e33", None, 10**33, 1e33), ("1.9999996", None, 1, 1.9999996), ("-1.9999999", None, -1, -1.9999999),
        ("1.5e0", None, 1, 1.5), ("-0.5", None, 0, -0.5), (".5", None, 0, 0.5), ("+7.", None, 7, 7.0), ("000012", None, 12, 12.0), ("9" * 39, None, None, 1e39), (".", None, None, None),
    ],
)
def test_coercion(spark, raw, boolean, integer, number):
    value = F.lit(raw)
    assert one(spark, coerce.to_boolean(value)) is boolean
    assert one(spark, coerce.to_integer(value)) == integer
    assert one(spark, coerce.to_float(value)) == number


def test_dates(spark):
    assert str(one(spark, coerce.to_date(F.lit("2024-03-01T10:20:30Z")))) == "2024-03-01"
    assert one(spark, coerce.to_date(F.lit("soon"))) is None


def test_schema_forms():
    old = {"a": {"data_type": "Int64"}, "b": {"data_type": "Date"}}
    assert coerce.schema_types(old) == coerce.schema_types({"columns": old}) == {"a": "integer", "b": "date"}


def test_dates_by_name_only_on_request(spark):
    df = spark.createDataFrame([("2024-01-02", "x")], "createdat string, other string")
    assert dict(coerce.apply_schema(df, {}).dtypes)["createdat"] == "string"
    assert dict(coerce.apply_schema(df, {}, dates_by_name=True).dtypes)["createdat"] == "date"


@pytest.mark.parametrize(
    ("raw", "clean"), [(" A b-C!!d ", "a_b_c_d"), ("__x__", "x"), ("createdAt", "createdat"), ("é", "")]
)
def test_sanitize(spark, raw, clean):
    assert keys.sanitize_name(raw) == clean == one(spark, keys.sanitize_key(F.lit(raw)))


@pytest.mark.parametrize(("raw", "clean"), [("a.b-c d", "a_b_c_d"), ("1st", "col_1st"), ("A__B", "a_b")])
def test_clean_name(spark, raw, clean):
    assert keys.clean_name(raw) == clean == one(spark, keys.clean_column(F.lit(raw)))


def test_clean_names_collide(spark):
    with pytest.raises(ValueError, match="collide"):
        keys.rename_clean(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_composite_key_with_missing_parts(spark):
    df = spark.createDataFrame([("n", None, 7)], "source_network string, source_proposal_type string, index int")
    assert df.select(keys.composite_key(df, keys.RECORD_KEY).alias("k")).first()["k"] == "n__7_"


@pytest.mark.parametrize(
    ("network", "kind", "title", "link", "shown"),
    [
        (None, None, None, "https://polkadot.s.test/referenda/5", "[Proposal 5](https://polkadot.s.test/referenda/5)"),
        ("Kusama", "Discussion", "T", "https://kusama.s.test/post/5", "[T](https://kusama.s.test/post/5)"),
        ("kusama", "Bounty", "T", None, None),
        ("other", "ReferendumV2", "T", None, None),
    ],
)
def test_links(spark, network, kind, title, link, shown):
    df = spark.createDataFrame([(5, network, kind, title)], "proposal_index int, network string, proposal_type string, title string")
    row = links.with_proposal_link(df, "s.test").first()
    assert (row["proposal_link"], row["proposal_link_display"]) == (link, shown)


@pytest.mark.parametrize(
    ("text", "meaningful"),
    [
        ("three good words", True), ("two words", False), ("short a b", False), ("2024-01-01 10:00, 11:00; 12", False),
        ("http://x.test is a link", False), ("aa aa aa aa aa", False), ("x" * 5001 + " a b", False), (None, None),
    ],
)
def test_meaningful(spark, text, meaningful):
    assert one(spark, t.is_meaningful(F.lit(text).cast("string"))) is meaningful


def test_images(spark):
    text = "keep\n![a](https://ok.test/a.png)\n![a](https://ok.test/a.png) ![b](http://bad.test/b)\n[link](http://bad.test)"
    kept = one(spark, t.keep_allowed_images(F.lit(text), "https://ok.test"))
    assert kept == "keep\n![a](https://ok.test/a.png)\n[link](http://bad.test)"


def test_markdown(spark):
    found = one(spark, t.markdown_matches(F.lit("# Head\n**b** and `c` -> [x](y) ~~z~~")))
    assert [f["issue"] for f in found] == [
        "Bold markdown (**text**)", "Italic markdown (*text*)", "Headers (# ## ###)", "Inline code (`code`)",
        "Links ([text](url))", "Arrow symbols (->)", "Strikethrough (~~text~~)",
    ]


def test_previews(spark):
    assert one(spark, t.content_preview(F.lit("x" * 201))) == "x" * 200 + "..."
    assert one(spark, t.content_preview(F.lit(None).cast("string"))) == ""
    assert one(spark, t.content_preview(F.lit("# *b*"), keep_markdown=False)) == "b"
    assert one(spark, t.format_epoch(F.lit(0))) == "Unknown date"
    assert one(spark, t.format_epoch(F.lit(1700000000))) == "2023-11-14 22:13:20"


@pytest.mark.parametrize(
    ("text", "greeting"),
    [("Hi", True), (" HELLO ", True), ("hi there", True), ("highest vote", False), ("hi what is the total", False), ("tell me more about it", False)],
)
def test_greeting(spark, text, greeting):
    assert one(spark, classify.is_greeting(F.lit(text))) is greeting


@pytest.mark.parametrize(
    ("text", "source", "table"),
    [("Who voted on proposal 5?", "ONCHAIN", "voting_data"), ("Show proposal 5", "ONCHAIN", "governance_data"), ("What is JAM?", "STATIC", None)],
)
def test_route(spark, text, source, table):
    assert tuple(one(spark, classify.route(F.lit(text)))) == (source, table)


def test_topics(spark):
    assert one(spark, classify.topic(F.lit("Validator votes"))) == "governance"
    assert one(spark, classify.topic(F.lit("Slot"))) == "parachain"
    got = one(spark, classify.topic_terms(F.lit("the xcm bridge and DOT"), F.lit("a bridge?"), F.lit("Guide - part 1")))
    assert got == ["DOT", "Guide", "xcm"]


def test_fixed_header(spark):
    full = "Title: A\nURL: u\nType: page\nDescription: d\n\nlead\n=======\n body \n"
    assert tuple(one(spark, documents.fixed_header(F.lit(full)))) == ("A", "u", "page", "d", "body")
    assert tuple(one(spark, documents.fixed_header(F.lit("Title: A\n\nbody")))) == ("A", None, None, None, "body")
    assert tuple(one(spark, documents.fixed_header(F.lit("no header")))) == (None, None, None, None, "no header")


def test_free_header(spark):
    got = one(spark, documents.free_header(F.lit("URL: u\nTitle: A\n---\nbody\n\nend"), F.lit("stem")))
    assert tuple(got) == ("A", "u", None, None, "body\n\nend")
    assert tuple(one(spark, documents.free_header(F.lit("body\nTitle: late"), F.lit("stem"))))[::4] == ("late", "")
    assert tuple(one(spark, documents.free_header(F.lit("body"), F.lit("stem"))))[::4] == ("stem", "body")


def test_default_type(spark):
    df = spark.createDataFrame([("ReferendumV2",), ("Bounty",)], "proposal_type string")
    assert [r[0] for r in df.where(p.of_type()).collect()] == ["ReferendumV2"]
    assert [r[0] for r in df.where(p.of_type("Bounty")).collect()] == ["Bounty"]


def test_search_text_is_literal(spark):
    df = spark.createDataFrame([("100%",), ("100 of",), (None,)], "x string")
    assert [r[0] for r in df.where(p.contains_ci("0%", "x")).collect()] == ["100%"]


def test_projections(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    with pytest.raises(ValueError, match="missing"):
        union.project_strict(df, ["a", "x"])
    kept, missing, extra = union.project_lenient(df, ["b", "x", "b"])
    assert (kept.columns, missing, extra) == (["b"], ["x"], ["a", "c"])


def test_roles():
    names = ["proposal_id", "created_at", "amount", "status", "title", "x"]
    assert [role_of(n) for n in names] == ["key", "date", "numeric", "status", "content", "other"]
