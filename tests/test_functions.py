from pyspark.sql import functions as F

from foliodiff.functions import lines, names
from foliodiff.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_normalisation(spark):
    lit = F.lit
    assert value(spark, t.normalize_text(lit("  a   b c​\r\nd\r\r\r\re "))) == "a b c\nd\n\ne"
    assert value(spark, t.normalize_key(lit("Ferry Fares (NOK)"))) == "ferry fares nok"
    assert value(spark, t.equality_key(lit("Port  of | Ellmere"))) == value(spark, t.equality_key(lit("port Of Ellmere")))
    assert value(spark, t.tokens(lit("B | a, b"))) == ["a", "b", "b"]
    assert value(spark, t.humanize(lit("tideTables_v3-old"))) == "Tide Tables V3 Old"
    assert value(spark, t.one_line(lit("a\n b" * 100), 5)) == "a ba …"
    assert value(spark, t.escape_html(lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert [value(spark, t.is_numeric(lit(x))) for x in ("1", "-1.5e3", ".5", "1,000", "x")] == [True, True, True, False, False]
    assert value(spark, t.normalize_text(F.lit(None).cast("string"))) is None


def test_columns(spark):
    for n, letters in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")):
        assert value(spark, t.column_letters(F.lit(n))) == letters
        assert value(spark, t.column_index(F.lit(letters))) == n


def test_word_diff(spark):
    found = value(spark, t.word_diff(F.lit("a b c"), F.lit("a x c d")))
    assert [(s.value, s.added, s.removed) for s in found] == [
        ("a", False, False), (" ", False, False), ("b", False, True), ("x", True, False), (" ", False, False), ("c", False, False), (" ", True, False), ("d", True, False),
    ]


def test_versions(spark):
    for name, want in (
        ("salesreport_2608041001.docx", ("salesreport", "2608041001")), ("q1_report_final.docx", ("q1_report", "final")), ("invoice_v2.xlsx", ("invoice", "v2")),
        ("customer_report.docx", ("customer_report", "")), ("final.pdf", ("final", "final")), ("v2.csv", ("v2", "v2")),
    ):
        assert tuple(value(spark, names.split_version(F.lit(name)))) == want


def test_natural_order(spark):
    rows = ["v10", "v2", "", "a", "v2b", "2608041001", "v"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in rows], "x string").orderBy(names.natural_key(F.col("x"))).collect()]
    assert got.index("v2") < got.index("v2b") < got.index("v10") and got[0] == "" and got.index("v") < got.index("v2")


def test_lines(spark):
    text = "a  \r\n\nword/document.xml\nPK\x03\x04 x\n\\rtf1\\ansi\nüber\n# Head\n- item\n|---|\nKey: v\nx | y\nplain\n"
    assert value(spark, lines.clean_lines(F.lit(text))) == ["a", "über", "# Head", "- item", "|---|", "Key: v", "x | y", "plain"]
    classes = [value(spark, lines.line_class(F.lit(x))) for x in ("# Head", "- item", "|---|", "Key: v", "x | y", "plain")]
    assert classes == ["heading", "list_item", "separator", "field", "pipe_row", "paragraph"]
