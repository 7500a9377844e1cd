"""Queries over fixed cases, whose SQL states the expected rows as they follow from the rules."""

from __future__ import annotations

import operator
from functools import partial

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import spans as S
from ..functions import text as T
from ..functions import validators as V
from ..functions.patterns import EXTRA, TIER0, UNLABELED
from ..operators import actions as X
from ..operators import detect as D
from ..operators import fuse as U
from ..operators import layout as L
from ..operators import pages as P
from ..operators import sessions as N
from ..sources.html import elements, segments
from ..streaming import streams as M

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Texts for each detector, and how many matches each has.
DETECTORS = {
    "P1": (("john.doe@example.com", 1), ("me@office", 0)),
    "P2": (("pay to user@okhdfcbank now", 1), ("john.doe@example.com", 0), ("contact me@office", 1)),
    "P3": (("call 9876543210", 1), ("+91-9876543210", 1), ("19876543210", 0), ("5876543210", 0)),
    "P4": (("DOB: 05/07/2002", 1), ("Date of Birth 5-7-02", 1), ("born 05/07/2002", 0)),
    "P5": (("Age: 42 years", 1), ("aged 42", 0), ("page 12", 0)),
    "P6": (("id 234567890124 end", 1), ("id 2345 6789 0124 end", 1), ("id 234567890125 end", 0), ("id 099999999999 end", 0), ("order 123456789012 shipped", 0), ("short 12345 end", 0)),
    "P7": (("ABCDE1234F", 1), ("ABCDE12345", 0)),
    "P8": (("A1234567", 1), ("AB1234567", 0)),
    "P9": (("ABC1234567", 1), ("ABCD1234567", 0)),
    "P10": (("MH-12-2011-0012345", 1), ("MH122011001234", 0)),
    "P11": (("4111 1111 1111 1111", 1), ("4111 1111 1111 1112", 0)),
    "P12": (("account number 123456789012", 1), ("a/c no. 123456789", 1), ("account 12345678", 0)),
    "P13": (("DE89370400440532013000", 1), ("DE88370400440532013000", 0)),
    "P14": (("SBIN0001234", 1), ("SBIN1001234", 0)),
    "P16": (("27ABCDE1234F1Z5", 1), ("27ABCDE1234F1A5", 0)),
    "P18": (("10.0.255.1", 1), ("10.0.256.1", 0)),
    "P19": (("00:1A:2b:3c:4d:5e", 1), ("00:1A:2b:3c:4d", 0)),
    "P20": (("device id: abc-123-xyz", 1), ("device abc123456", 0)),
    "P21": (("username john_doe_99", 1), ("user john", 0)),
    "P22": (("password: s3cret!", 1), ("password s3cret!", 0)),
    "P23": (("PIN: 4829", 1), ("pin: 4829", 0), ("PIN 123", 0)),
    "P24": (("OTP 482910", 1), ("482910", 0), ("one-time password: 1234", 1)),
    "P25": (("api_key = abcdefghijkl12", 1), ("api key: short", 0)),
    "P26": (("Employee ID: E-1234", 1), ("employee 1234", 0)),
    "P27": (("customer no. C12345", 1), ("customer 12345", 0)),
    "P28": (("student id S1234", 1), ("student S1234", 0)),
    "P29": (("Patient number: PT-9981", 1), ("patient PT-9981", 0)),
    "P30": (("policy no POL12345", 1), ("policy 12345", 0)),
    "P32": (("jeet dot routh at gmail", 1), ("meet me at noon", 0)),
    "P33": (("Tamluk@2019", 1), ("name@host", 0)),
    "P34": (("ann@site.org", 1), ("ann@example.com", 0)),
    "P35": (("(555) 014-2288", 1), ("555 014", 0)),
    "P36": (("07/05/2002", 1), ("31-12-1999", 1), ("2024-02-29", 1), ("13/45/2000", 0)),
    "P37": (("card ending in 4242", 1), ("ending 42", 0)),
    "P38": (("jeet dot routh at gmail", 1), ("meet me at noon", 0)),
    "P39": (("Tamluk@2019", 1), ("name@host", 0)),
    "P40": (("S B I N 0 0 0 1 2 3 4", 1), ("SBIN1001234", 0)),
    "P41": (("1Z999AA10123456784", 1), ("123456789012", 1), ("1234567", 0)),
    "P42": (("GB 123 4567 89", 1), ("DE123456789", 1), ("XX123456789", 0)),
}


def quoted(value) -> str:
    """A Python value as SQL."""
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)


def values(rows, columns: str) -> str:
    """SQL for literal rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") t({columns})"


def p_cases(spark, sf_dir):
    """Each detector's cases: matches by shape, check and all."""
    parts = None
    for p_id, cases in DETECTORS.items():
        rows = spark.createDataFrame([(p_id, i, t) for i, (t, _) in enumerate(cases)], "detector string, n_case int, text string").coalesce(1)
        if any(p.id == p_id for p in TIER0):
            n = S.count(F.col("text"), next(p for p in TIER0 if p.id == p_id))
        elif any(p.id == p_id for p in EXTRA):
            kind = next(p.type for p in EXTRA if p.id == p_id)
            n = F.size(F.filter(F.transform(D.extra_spans(F.col("text")), lambda s: s.type), partial(operator.eq, kind)))
        else:
            found = S.matches(F.col("text"), [(p, 0) for p in UNLABELED if p.id == p_id], "format", check=False)
            n = F.size(F.filter(found, lambda s: D.unlabeled_ok(s.type, s.value)))
        out = rows.select("detector", "n_case", n.cast("long").alias("n_matches"))
        parts = out if parts is None else parts.union(out)
    return parts


SQL["p_cases"] = "SELECT detector, CAST(n_case AS INT) AS n_case, CAST(n AS BIGINT) AS n_matches FROM (" + values([(p, i, n) for p, cases in DETECTORS.items() for i, (_, n) in enumerate(cases)], "detector, n_case, n") + ")"

#: Texts, their detections, and what they become.
TEXTS = (
    ("pay to user@okhdfcbank now", "UPI_VPA@7-22", "pay to <UPI_VPA> now"),
    ("john.doe@example.com", "EMAIL_ID@0-20", "<EMAIL_ID>"),
    ("contact me@office", "UPI_VPA@8-17", "contact <UPI_VPA>"),
    ("order 123456789012 shipped", "", "order 123456789012 shipped"),
    ("username john_doe_99", "USERNAME@9-20", "username <USERNAME>"),
    ("password: s3cret!", "PASSWORD@10-17", "password: <PASSWORD>"),
    ("account number 123456789012", "BANK_ACCOUNT@15-27", "account number <BANK_ACCOUNT>"),
    ("PIN: 4829", "PIN@5-9", "PIN: <PIN>"),
    ("OTP 482910", "OTP@4-10", "OTP <OTP>"),
    ("482910", "", "482910"),
    ("\U0001f600 a@b.co, 10.0.0.1", "EMAIL_ID@2-8,IP_ADDRESS@10-18", "\U0001f600 <EMAIL_ID>, <IP_ADDRESS>"),
    ("", "", ""),
    (None, "", None),
)


def r1_cases(spark, sf_dir):
    """Redaction of fixed texts: disjoint detections and the text without their values."""
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "n_case int, text string")
    return D.redact(D.detect(rows)).select("n_case", F.coalesce(S.listed(F.col("detections")), F.lit("")).alias("detections"), "redacted")


SQL["r1_cases"] = "SELECT CAST(n_case AS INT) AS n_case, detections, redacted FROM (" + values([(i, d, r) for i, (_, d, r) in enumerate(TEXTS)], "n_case, detections, redacted") + ")"


def r3_cases(spark, sf_dir):
    """The same through the audits: none is blocked."""
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "n_case int, text string")
    return D.self_audit(rows).select("n_case", "blocked", "redacted")


SQL["r3_cases"] = "SELECT CAST(n_case AS INT) AS n_case, false AS blocked, redacted FROM (" + values([(i, r) for i, (_, _, r) in enumerate(TEXTS)], "n_case, redacted") + ")"

#: Spans that overlap (start, end, rank, confidence) and which stay: leftmost and longest first.
OVERLAPS = (
    (((0, 5, 1, 0.9), (3, 12, 2, 0.8), (12, 14, 3, 0.7)), "0-5,12-14", "3-12,12-14"),
    (((0, 4, 2, 0.5), (0, 4, 1, 0.5), (0, 9, 3, 0.1)), "0-9", "0-9"),
    (((5, 6, 1, 0.1), (6, 7, 1, 0.1)), "5-6,6-7", "5-6,6-7"),
    ((), "", ""),
)


def w_cases(spark, sf_dir):
    """Overlaps of fixed spans, leftmost first and longest first."""
    spans = [(i, [(a, b, r, "T", "", c, "") for a, b, r, c in rows]) for i, (rows, _, _) in enumerate(OVERLAPS)]
    df = spark.createDataFrame(spans, f"n_case int, spans {S.SPANS}")
    places = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.end.cast("string"))), ",")
    return df.select("n_case", places(S.resolve_leftmost(F.col("spans"))).alias("leftmost"), places(S.resolve_longest(F.col("spans"))).alias("longest"))


SQL["w_cases"] = "SELECT CAST(n_case AS INT) AS n_case, leftmost, longest FROM (" + values([(i, a, b) for i, (_, a, b) in enumerate(OVERLAPS)], "n_case, leftmost, longest") + ")"

#: Pages and their text as it may leave, white space collapsed.
PAGES = (
    ('<label for="a">Password</label><input id="a" value="abcdef">', "Password <PASSWORD>"),
    ('<input name="password" value="correct horse battery staple yes">', "<PASSWORD>"),
    ("<p>Password:</p><p>letmein</p>", "Password: <PASSWORD>"),
    ("<p>Password： hunter2x9</p>", "Password <PASSWORD>"),
    ('<img alt="gate pass: Tamluk2019">', "gate pass <PASSWORD>"),
    ("<p>Password: hunter2secret</p>", "Password <PASSWORD>"),
    ("<table><tr><th>Password</th><td>table-secret-9</td></tr></table>", "Password <PASSWORD>"),
    ("<table><thead><tr><th>Password</th></tr></thead><tbody><tr><td>col-secret-7</td></tr></tbody></table>", "Password <PASSWORD>"),
    ("<div>Password</div><a href=x>Forgot password?</a><div>madiwhfaoniof</div><div>••••</div><button>Hide password</button>", "Password <PASSWORD> Forgot password? •••• Hide password"),
    ("<div><h2>Password</h2></div><div><p>Welcome back to your account</p></div>", "Password Welcome back to your account"),
    ("<p>an email, just a filename: quarterly.pdf</p>", "an email, just a filename: quarterly.pdf"),
    ('<input type="hidden" value="token123"><input autocomplete="cc-number" value="4">', "<PASSWORD> <CARD_NUMBER>"),
    ("<div hidden>gone</div><script>var a</script><h1>Hello</h1><p>Write to john@site.org</p>", "Hello Write to <EMAIL_ID>"),
    (None, ""),
)


def _page_rows(spark, pages):
    return spark.createDataFrame([(i, p[0]) for i, p in enumerate(pages)], "page_id long, html string")


def l7_cases(spark, sf_dir):
    """Fixed pages with labels and values: what may leave."""
    text = F.trim(F.regexp_replace("sanitized_text", r"\s+", " "))
    return P.read_page(_page_rows(spark, PAGES)).select("page_id", text.alias("sanitized_text"))


SQL["l7_cases"] = "SELECT CAST(page_id AS BIGINT) AS page_id, sanitized_text FROM (" + values([(i, t) for i, (_, t) in enumerate(PAGES)], "page_id, sanitized_text") + ")"

#: Controls and cells with the label, hint or header that belongs to them.
LABELS = (
    ('<label for="a">Email address</label><input id="a" autocomplete="section-x email" name="m" value="v">', "v", "Email address", "EMAIL_ID", "m", None),
    ("<label>Phone <input value='v'></label>", "v", "Phone", None, None, None),
    ('<span id="x">Card</span><span id="y">number</span><input aria-labelledby="x y" autocomplete="off" value="v">', "v", "Card number", None, None, None),
    ("<textarea name=t>v</textarea>", "v", None, None, "t", None),
    ("<select name=s><option>a<option selected>v</select>", "v", None, None, "s", None),
    ("<table><tr><th>Name</th><th>Phone</th></tr><tr><td>Ann</td><td>v</td></tr></table>", "v", None, None, None, "Phone"),
)


def j1_cases(spark, sf_dir):
    """Fixed pages' controls and cells with value "v"."""
    found = segments(_page_rows(spark, LABELS)).where("text = 'v' and (kind = 'form_value' or tag = 'td')")
    return found.select("page_id", "text", "hint.label_text", "hint.autocomplete_type", "hint.field_name", "hint.table_header")


SQL["j1_cases"] = "SELECT CAST(page_id AS BIGINT) AS page_id, text, label_text, autocomplete_type, field_name, table_header FROM (" + values([(i, *r[1:]) for i, r in enumerate(LABELS)], "page_id, text, label_text, autocomplete_type, field_name, table_header") + ")"

#: Items of screens (id, text, x1, y1, x2, y2).
SCREENS = (
    (("0", "Certificate No: ABC123XY98", 100, 300, 620, 340), ("1", "Name: John", 100, 100, 300, 130), ("2", "Batch: 98", 100, 500, 200, 530)),
    (("0", "Certificate No:", 100, 300, 300, 330), ("1", "ABC123XY98", 100, 340, 300, 370)),
    (("0", "Certificate Number", 100, 300, 280, 330), ("1", "ABC 123 XY 98", 400, 300, 600, 330)),
    (("0", "Hello World", 100, 100, 300, 130),),
    (("0", "Card ending", 100, 100, 200, 130), ("1", "4242", 210, 100, 260, 130)),
    (("0", "Date of", 100, 100, 200, 120), ("1", "Birth: 05-07-2002", 100, 130, 300, 150)),
    (("0", "call", 100, 100, 140, 120), ("1", "(555) 014", 150, 100, 250, 120), ("2", "2288 now", 260, 100, 330, 120)),
)
KEYS = ["screen"]


def _screens(spark):
    rows = [(k, i, item, text, 0.9, tuple(map(float, box))) for k, items in enumerate(SCREENS) for i, (item, text, *box) in enumerate(items)]
    return spark.createDataFrame(rows, f"screen int, ord long, id string, text string, confidence double, box {G.BOX}")


def w3_cases(spark, sf_dir):
    """Reading order of fixed screens."""
    return L.reading_order(_screens(spark), KEYS).select("screen", "id", F.col("reading_order").cast("int").alias("reading_order"))


_ORDER = ((0, "1", 0), (0, "0", 1), (0, "2", 2), (1, "0", 0), (1, "1", 1), (2, "0", 0), (2, "1", 1), (3, "0", 0), (4, "0", 0), (4, "1", 1), (5, "0", 0), (5, "1", 1), (6, "0", 0), (6, "1", 1), (6, "2", 2))
SQL["w3_cases"] = "SELECT CAST(screen AS INT) AS screen, id, CAST(reading_order AS INT) AS reading_order FROM (" + values(_ORDER, "screen, id, reading_order") + ")"

_EXTRACT = {
    "l4_cases": (lambda o: L.same_line(o, KEYS), ((0, "0", "CERTIFICATE_NUMBER", "ABC123XY98", 0.98),)),
    "j6_cases": (lambda o: L.side_by_side(o, KEYS), ((2, "0,1", "CERTIFICATE_NUMBER", "ABC 123 XY 98", 0.92),)),
    "j7_cases": (lambda o: L.vertical(o, KEYS), ((1, "0,1", "CERTIFICATE_NUMBER", "ABC123XY98", 0.9), (5, "0,1", "DATE_OF_BIRTH", "Birth: 05-07-2002", 0.9))),
    "j8_cases": (lambda o: L.multi_line(o, KEYS), ((0, "1,0", "CERTIFICATE_NUMBER", "ABC123XY98", 0.88), (0, "0,2", "CERTIFICATE_NUMBER", "98", 0.88), (5, "0,1", "DATE_OF_BIRTH", "05-07-2002", 0.88))),
    "j9_cases": (lambda o: L.cross_item(o, KEYS), ((4, "1", "CARD_NUMBER", "4242", 0.88),)),
    "l9_cases": (lambda o: L.row_formats(o, KEYS), ((6, "1,2", "PHONE", "(555) 014 2288", 0.9),)),
    "l10_cases": (
        lambda o: L.field_candidates(o.drop("row", "row_y", "reading_order", "hit"), KEYS),
        (
            (0, "0", "CERTIFICATE_NUMBER", "ABC123XY98", 0.98), (0, "0,2", "CERTIFICATE_NUMBER", "98", 0.88), (1, "0,1", "CERTIFICATE_NUMBER", "ABC123XY98", 0.9), (2, "0,1", "CERTIFICATE_NUMBER", "ABC 123 XY 98", 0.92),
            (4, "1", "CARD_NUMBER", "4242", 0.88), (5, "0,1", "DATE_OF_BIRTH", "Birth: 05-07-2002", 0.9), (5, "0,1", "DATE_OF_BIRTH", "05-07-2002", 0.88), (6, "1,2", "PHONE", "(555) 014 2288", 0.9),
        ),
    ),
}


def _extract(make):
    def query(spark, sf_dir):
        found = make(L.with_labels(L.reading_order(_screens(spark), KEYS)))
        return found.select("screen", F.array_join("ids", ",").alias("ids"), "field_type", "value", F.round("confidence", 6).alias("confidence"))

    return query


for _name, (_make, _rows) in _EXTRACT.items():
    QUERIES[_name] = _extract(_make)
    SQL[_name] = "SELECT CAST(screen AS INT) AS screen, ids, field_type, value, CAST(confidence AS DOUBLE) AS confidence FROM (" + values(_rows, "screen, ids, field_type, value, confidence") + ")"

#: Boxes with scores: two that overlap by more than 0.3, and another.
FACES = (((100, 100, 200, 200), 0.95), ((105, 105, 195, 195), 0.85), ((300, 300, 400, 400), 0.9))


def k2_cases(spark, sf_dir):
    """Suppression of fixed boxes: the scores that stay, best first."""
    rows = [(float(s), tuple(map(float, b))) for b, s in FACES]
    df = spark.createDataFrame([(rows,)], f"boxes array<struct<score:double,box:{G.BOX}>>")
    return df.select(F.posexplode(G.suppress(F.col("boxes"))).alias("nth", "b")).select("nth", F.col("b.score").alias("score"))


SQL["k2_cases"] = "SELECT CAST(nth AS INT) AS nth, CAST(score AS DOUBLE) AS score FROM (VALUES (0, 0.95), (1, 0.9)) t(nth, score)"

#: What stands within 80 characters on either side of a span, with a space for it.
CONTEXTS = (("a" * 100 + "XYZ" + "b" * 100, 100, 103, "a" * 80 + " " + "b" * 80), ("XYZ", 0, 3, " "))


def v6_cases(spark, sf_dir):
    """Contexts of fixed spans."""
    df = spark.createDataFrame([(i, t, a, b) for i, (t, a, b, _) in enumerate(CONTEXTS)], "n_case int, text string, a int, b int")
    return df.select("n_case", V.context(F.col("text"), F.col("a"), F.col("b")).alias("context"))


SQL["v6_cases"] = "SELECT CAST(n_case AS INT) AS n_case, context FROM (" + values([(i, c) for i, (_, _, _, c) in enumerate(CONTEXTS)], "n_case, context") + ")"

#: Values, texts, and whether the value's pattern holds in the text.
PATTERNS = (("a b", "x a  b y", True), ("a b", "x a\n\tb y", True), ("a b", "ab", True), ("a.b", "axb", False), ("a b", "a x b", False), ("(c", "(c", True))


def t9_cases(spark, sf_dir):
    """Patterns of fixed values, which hold whatever the white space between words."""
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(PATTERNS)], "n_case int, value string, text string")
    found = df.select("n_case", "text", T.value_pattern(F.col("value")).alias("pattern"))
    return found.select("n_case", F.expr("rlike(text, pattern)").alias("holds"))


SQL["t9_cases"] = "SELECT CAST(n_case AS INT) AS n_case, holds FROM (" + values([(i, h) for i, (_, _, h) in enumerate(PATTERNS)], "n_case, holds") + ")"

#: Findings of a model (ner) or a rule (source, text, label, confidence, box), and the texts and
#: sources that are left of them.
FINDINGS = (
    ((("ner", "ABC123XY98", None, 0.9, (100, 100, 300, 130)), ("ner", "98", None, 0.6, (100, 100, 300, 130))), (("ABC123XY98", "ner"),)),
    ((("ner", "ABC123XY98", None, 0.9, (100, 100, 300, 130)), ("deterministic_context", "ABC123XY98", "Certificate No", 0.98, (100, 100, 300, 130))), (("ABC123XY98", "deterministic_context,ner"),)),
    ((("ner", "ABC123", None, 0.9, (100, 100, 300, 130)), ("ner", "XYZ789", None, 0.8, (100, 400, 300, 430))), (("ABC123", "ner"), ("XYZ789", "ner"))),
)


def a2_cases(spark, sf_dir):
    """Fixed findings, fused."""
    rows = [(k, s, [f"ocr_{b[1]}"], t, lab, "CERTIFICATE_NUMBER", c, tuple(map(float, b)), i) for k, (found, _) in enumerate(FINDINGS) for i, (s, t, lab, c, b) in enumerate(found)]
    df = spark.createDataFrame(rows, f"doc_id int, source string, ids array<string>, text string, label string, type string, confidence double, box {G.BOX}, ord long")
    return U.fuse(df, ["doc_id"]).select("doc_id", "text", F.array_join(F.array_sort("sources"), ",").alias("sources"))


SQL["a2_cases"] = "SELECT CAST(doc_id AS INT) AS doc_id, text, sources FROM (" + values([(k, *x) for k, (_, left) in enumerate(FINDINGS) for x in left], "doc_id, text, sources") + ")"

#: A page's elements: ref, tag, role, label, type, and whether they submit a form.
FORM = (
    '<a href="/x">Go <b>there</b></a><a>none</a><form><label for="q">Find it</label><input id="q" name="qq" type="search"><input type="hidden" value="t"><button>Send</button>'
    '<button type="button" aria-label="Close">x</button><input type="checkbox" name="ok"><select title="Pick"><option value="a">A</option><option>B</option></select></form>'
    '<div role="button">Tap</div><button hidden>no</button><textarea placeholder="Say"></textarea><button>Free</button>'
)
ELEMENTS = (
    ("el_1", "a", "link", "Go there", "", False), ("el_2", "input", "textbox", "Find it", "search", False), ("el_3", "button", "button", "Send", "", True), ("el_4", "button", "button", "Close", "", False),
    ("el_5", "input", "checkbox", "ok", "checkbox", False), ("el_6", "select", "combobox", "A B", "select", False), ("el_7", "div", "button", "Tap", "", False), ("el_8", "textarea", "textbox", "Say", "textarea", False),
    ("el_9", "button", "button", "Free", "", False),
)


def t13_cases(spark, sf_dir):
    """The elements of a fixed page."""
    return elements(_page_rows(spark, [(FORM,)])).select("ref", "tag", "role", "label", "input_type", "is_submit")


SQL["t13_cases"] = values(ELEMENTS, "ref, tag, role, label, input_type, is_submit")

#: Actions on that page (tool, ref, text, value, direction), why they cannot be done, and whether
#: they submit a form.
ACTIONS = (
    ("click", "el_3", None, None, None, None, True), ("click", "el_1", None, None, None, None, False), ("click", "el_99", None, None, None, "unknown-ref", None), ("fly", "el_1", None, None, None, "unsupported-tool", None),
    ("type", "el_2", "hi", None, None, None, False), ("type", "el_2", None, None, None, "bad-arguments", False), ("type", "el_5", "hi", None, None, "not-typeable", False), ("type", "el_8", "hi", None, None, None, False),
    ("select_option", "el_6", None, "a", None, None, False), ("select_option", "el_6", None, "B", None, None, False), ("select_option", "el_6", None, "C", None, "invalid-option", False), ("select_option", "el_6", None, None, None, "bad-arguments", False),
    ("select_option", "el_2", None, "a", None, "not-typeable", False), ("submit", "el_2", None, None, None, None, True), ("submit", "el_9", None, None, None, "no-form", True), ("scroll", None, None, None, "down", None, False),
    ("scroll", None, None, None, "left", "bad-arguments", False), ("click", None, None, None, None, "unknown-ref", None),
)


def c3_cases(spark, sf_dir):
    """Previews and checks of fixed actions."""
    rows = spark.createDataFrame([(i, 0, *a[:5]) for i, a in enumerate(ACTIONS)], "n_case int, page_id long, tool string, ref string, text string, value string, direction string")
    found = elements(_page_rows(spark, [(FORM,)]))
    seen = X.preview(rows, found).select("n_case", "is_form_submit")
    return X.execution(rows, found).join(seen, "n_case").select("n_case", "tool", "reason", "is_form_submit")


SQL["c3_cases"] = "SELECT CAST(n_case AS INT) AS n_case, tool, reason, is_form_submit FROM (" + values([(i, a[0], a[5], a[6]) for i, a in enumerate(ACTIONS)], "n_case, tool, reason, is_form_submit") + ")"

#: Messages of clients (client, id, at, kind) and what becomes of them.
MESSAGES = (
    ("a", "1", 0.0, "request", "sent"), ("a", "1", 1.0, "request", "duplicate-id"), ("b", "1", 1.0, "request", "sent"), ("a", "1", 2.0, "response", "answered"), ("a", "1", 3.0, "response", "dropped"),
    ("a", "1", 4.0, "request", "sent"), ("a", "2", 5.0, "request", "sent"), ("a", "", 6.0, "close", "swept 2"), ("a", "1", 7.0, "response", "dropped"), ("b", "1", 70.0, "response", "dropped"), ("b", "1", 71.0, "request", "sent"),
)


def m3_cases(spark, sf_dir):
    """Outcomes of fixed messages."""
    return M.replay_requests(spark.createDataFrame([m[:4] for m in MESSAGES], "client string, id string, at double, kind string"))


SQL["m3_cases"] = "SELECT client, id, CAST(\"at\" AS DOUBLE) AS \"at\", kind, outcome FROM (" + values(MESSAGES, 'client, id, "at", kind, outcome') + ")"

#: Greetings (token, role) and their answers, given two paired clients.
GREETINGS = (("t1", None, "welcome", "ext-1"), ("t1", "agent", "unauthorized", None), ("t2", "agent", "welcome", "agent-1"), ("t2", None, "unauthorized", None), ("no", None, "unauthorized", None), (None, None, "unauthorized", None))


def m15_cases(spark, sf_dir):
    """Fixed greetings."""
    paired = spark.createDataFrame([("t1", "ext-1", None), ("t2", "agent-1", "agent")], "token string, client_id string, role string")
    return X.hello(spark.createDataFrame([g[:2] for g in GREETINGS], "token string, role string"), paired)


SQL["m15_cases"] = values(GREETINGS, "token, role, status, client_id")


def k7_cases(spark, sf_dir):
    """The socket that gets the calls of a bridge."""
    rows = [("x", "ext-1", "extension", True, True, 5), ("x", "ext-2", "extension", True, True, 9), ("x", "ext-3", "extension", True, False, 12), ("x", "agent-1", "agent", True, True, 20), ("y", "ext-4", "extension", False, True, 1)]
    return X.target_socket(spark.createDataFrame(rows, "bridge string, client_id string, role string, authenticated boolean, open boolean, last_active long"), ["bridge"])


SQL["k7_cases"] = "SELECT 'x' AS bridge, 'ext-2' AS client_id"

#: What a model names (raw, id, items, text, type, confidence), the candidate that it stands for, and
#: why it has no region.
NAMED = (
    ("c0", None, None, None, None, None, "c0", "o0", "ABC123", "CERT", 0.9, "existing", None), ("o1", None, None, None, None, None, "c1", "o1", "Ann", "PERSON", 0.8, "existing", None),
    ("o2", None, None, None, None, None, "model_o2", "o2", "Total 5", "person", 0.95, "additional", None), (" ann ", None, None, None, None, None, "c1", "o1", "Ann", "PERSON", 0.8, "existing", None),
    ("zzz", None, None, None, None, None, "model_zzz", "", "zzz", "person", 0.9, "additional", "unresolved"), (None, None, ["o0"], None, None, None, "c0", "o0", "ABC123", "CERT", 0.9, "existing", None),
    (None, None, None, "x", "PIN", 0.5, "model_item", "", "x", "PIN", 0.5, "additional", "unresolved"), (None, None, ["o2"], "Bob", "NAME", 0.7, "model_item", "o2", "Bob", "NAME", 0.7, "additional", "label"),
)


def l16_cases(spark, sf_dir):
    """Fixed outputs of a model as candidates, and their regions."""
    box = (0.0, 0.0, 100.0, 10.0)
    fused = spark.createDataFrame([(1, "c0", ["o0"], "ABC123", ["CERT"], 0.9), (1, "c1", ["o1"], "Ann", ["PERSON"], 0.8)], "image int, candidate_id string, ids array<string>, text string, types array<string>, confidence double")
    items = spark.createDataFrame([(1, "o0", "No: ABC123", 0.95, box), (1, "o1", "Ann", 0.95, box), (1, "o2", "Total 5", 0.95, box)], f"image int, id string, text string, confidence double, box {G.BOX}")
    named = spark.createDataFrame([(1, i, *n[:6], False) for i, n in enumerate(NAMED)], "image int, nth int, raw string, candidate_id string, ids array<string>, text string, type string, confidence double, additional boolean")
    found = U.final_regions(U.normalize_items(named, fused, items, ["image"]), items, ["image"])
    return found.select("nth", "candidate_id", F.array_join("ids", ",").alias("ids"), "text", "type", "confidence", "decision", "rejected")


SQL["l16_cases"] = "SELECT CAST(nth AS INT) AS nth, candidate_id, ids, text, type, CAST(confidence AS DOUBLE) AS confidence, decision, rejected FROM (" + values([(i, *n[6:]) for i, n in enumerate(NAMED)], "nth, candidate_id, ids, text, type, confidence, decision, rejected") + ")"

#: Devices (vendor, description, fallback) and their tiers.
DEVICES = (
    ("NVIDIA", "", False, "dedicated"), ("nvidia", "x", True, "cpu"), ("AMD", "Radeon 740M", False, "integrated"), ("AMD", "Radeon RX 7600", False, "dedicated"), (None, "Radeon RX 7600", None, "integrated"),
    ("intel", "Arc A770", False, "dedicated"), ("apple", None, False, "integrated"), (None, "some adapter", False, "integrated"), (None, None, False, "unknown"), ("", "", None, "unknown"),
)


def v21_cases(spark, sf_dir):
    """Tiers of fixed devices."""
    df = spark.createDataFrame([(i, *d[:3]) for i, d in enumerate(DEVICES)], "n_case int, vendor string, description string, fallback boolean")
    return df.select("n_case", N.gpu_tier(F.col("vendor"), F.col("description"), F.col("fallback")).alias("tier"))


SQL["v21_cases"] = "SELECT CAST(n_case AS INT) AS n_case, tier FROM (" + values([(i, d[3]) for i, d in enumerate(DEVICES)], "n_case, tier") + ")"

#: Asks for approval (id, at), their answers, and what comes of them.
ASKS = (("a", 0.0, True, "approve"), ("b", 0.0, False, "deny"), ("c", 0.0, False, "timeout"), ("d", 0.0, False, "timeout"), ("e", 100.0, False, "dismiss"), ("f", 0.0, True, "approve"))
ANSWERS = (("a", 10.0, "approve"), ("a", 11.0, "deny"), ("b", 5.0, "deny"), ("b", 6.0, "approve"), ("c", 55.5, "approve"), ("e", 50.0, "approve"), ("e", 120.0, "dismiss"), ("f", 55.0, "approve"), ("z", 1.0, "approve"))


def m7_cases(spark, sf_dir):
    """Fixed approvals."""
    asks = spark.createDataFrame([a[:2] for a in ASKS], "id string, at double")
    return N.approvals(asks, spark.createDataFrame(list(ANSWERS), "id string, at double, kind string"), ["id"])


SQL["m7_cases"] = "SELECT id, CAST(\"at\" AS DOUBLE) AS \"at\", approved, reason FROM (" + values(ASKS, 'id, "at", approved, reason') + ")"

#: Calls (session, at, took, timed out) and whether they are skipped: a skipped one starts no rest.
CALLS = (("s", 0.0, 10.0, True, False), ("s", 50.0, 10.0, True, True), ("s", 99.0, 1.0, True, True), ("s", 100.0, 5.0, False, False), ("s", 106.0, 4.0, True, False), ("s", 199.0, 1.0, False, True), ("s", 200.0, 1.0, False, False), ("t", 50.0, None, None, False))


def m8_cases(spark, sf_dir):
    """Rests after the timeouts of fixed calls."""
    return N.cooldowns(spark.createDataFrame([c[:4] for c in CALLS], "session string, at double, took double, timed_out boolean"), "session")


SQL["m8_cases"] = "SELECT session, CAST(\"at\" AS DOUBLE) AS \"at\", skipped FROM (" + values([(c[0], c[1], c[4]) for c in CALLS], 'session, "at", skipped') + ")"

#: Captures (session, at, device events) and why they ask for a restart, one every three captures.
CAPTURES = (
    ("s", 1.0, [], None), ("s", 2.0, None, None), ("s", 3.0, [], "capture-count 3 >= 3"), ("s", 4.0, [], None), ("s", 5.0, [(4.5, "lost"), (4.7, "slow")], "gpu-event (2 new: lost,slow)"),
    ("s", 6.0, [(4.7, "slow")], None), ("s", 7.0, [(4.7, "slow"), (6.5, "lost")], "gpu-event (1 new: lost)"), ("t", 1.0, [], None),
)


def m9_cases(spark, sf_dir):
    """Restarts after fixed captures."""
    return N.restarts(spark.createDataFrame([c[:3] for c in CAPTURES], "session string, at double, events array<struct<t:double,kind:string>>"), "session", 3)


SQL["m9_cases"] = "SELECT session, CAST(\"at\" AS DOUBLE) AS \"at\", reason FROM (" + values([(c[0], c[1], c[3]) for c in CAPTURES], 'session, "at", reason') + ")"


def l19_cases(spark, sf_dir):
    """The digest of a fixed layout."""
    rows = [(1, [("Name: Ann", (1.5, 2.4, 30.0, 9.9)), ("", (0.0, 0.0, 1.0, 1.0)), (None, None), ("no box", None)]), (2, [])]
    df = spark.createDataFrame(rows, f"screen int, items array<struct<text:string,box:{G.BOX}>>")
    return df.select("screen", N.layout_digest(F.col("items")).alias("digest"))


SQL["l19_cases"] = """SELECT 1 AS screen, '- [2,2,30,10] "Name: Ann"' || chr(10) || '- [] "no box"' AS digest UNION ALL SELECT 2, ''"""

#: Runs (fixture, coverage, regions) and checks (task, ok, skipped).
RUNS = (("f", 0.5, 3), ("f", None, 5), ("f", 1.0, 4), ("g", None, None))
CHECKS = (("x", True, False), ("x", False, False), ("x", True, True), ("y", True, True), ("z", None, None), ("z", True, False))


def a10_cases(spark, sf_dir):
    """Accuracy over fixed runs."""
    return N.accuracy(spark.createDataFrame(list(RUNS), "fixture string, coverage double, regions int"), ["fixture"], ["coverage"], ["regions"])


SQL["a10_cases"] = "SELECT fixture, CAST(runs AS BIGINT) AS runs, CAST(m AS DOUBLE) AS coverage_mean, CAST(p AS DOUBLE) AS regions_p50 FROM (VALUES ('f', 3, 0.75, 4.0), ('g', 1, NULL, NULL)) t(fixture, runs, m, p)"


def a10_task_cases(spark, sf_dir):
    """Pass rates of fixed checks."""
    return N.pass_rates(spark.createDataFrame(list(CHECKS), "task string, ok boolean, skipped boolean"), ["task"])


SQL["a10_task_cases"] = "SELECT task, CAST(p AS BIGINT) AS passed, CAST(n AS BIGINT) AS scored, CAST(a AS DOUBLE) AS accuracy FROM (VALUES ('x', 1, 2, 0.5), ('y', 0, 0, NULL), ('z', 1, 2, 0.5)) t(task, p, n, a)"

#: Images, what a model says of their one candidate, and who decides, openly and closed.
SAID = ((1, "c0", "ok", None, "ok", None), (2, "cx", "fallback_after_model_failure", "fusion", "model_failed", "fail_closed"), (3, None, "fallback_fusion", "fusion", "model_skipped", "fail_closed"))


def _said(spark):
    box = (0.0, 0.0, 9.0, 9.0)
    fused = spark.createDataFrame([(i, "c0", ["o0"], "ABC123", ["CERT"], ["ner"], 0.9, box) for i, *_ in SAID], f"image int, candidate_id string, ids array<string>, text string, types array<string>, sources array<string>, confidence double, box {G.BOX}")
    said = spark.createDataFrame([(i, c, ["o0"], "CERT", "ABC123", 0.8) for i, c, *_ in SAID if c], "image int, candidate_id string, ids array<string>, type string, text string, confidence double")
    return spark.createDataFrame([(i, 100, 50) for i, *_ in SAID], "image int, width int, height int"), said, fused


def l18_cases(spark, sf_dir):
    """Fixed images: who decides, by either policy, and how many findings that leaves."""
    images, said, fused = _said(spark)
    out = None
    for closed in (False, True):
        n = U.adjudicate_or_fallback(fused, said, ["image"], ("CERT",), closed).groupBy("image").agg(F.count("*").alias("n"))
        one = U.outcomes(images, said, fused, ["image"], ("CERT",), closed).join(n, "image", "left").select("image", F.lit(closed).alias("closed"), "status", "redaction_complete", "fallback", F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"))
        out = one if out is None else out.union(one)
    return out


SQL["l18_cases"] = "SELECT CAST(image AS INT) AS image, closed, status, redaction_complete, fallback, CAST(n_findings AS BIGINT) AS n_findings FROM (" + values([(i, False, a, True, b, 1) for i, _, a, b, _, _ in SAID] + [(i, True, a, a == "ok", b, int(a == "ok")) for i, _, _, _, a, b in SAID], "image, closed, status, redaction_complete, fallback, n_findings") + ")"


def l23_cases(spark, sf_dir):
    """What a model is shown of a fixed image, as JSON, and of one without anything."""
    images, _, fused = _said(spark)
    box = (0.0, 0.0, 9.0, 9.0)
    items = spark.createDataFrame([(1, "o1", " b\n c ", box, 0.5), (1, "o0", None, None, 0.9)], f"image int, id string, text string, box {G.BOX}, confidence double")
    found = spark.createDataFrame([(1, "CERT", "ABC123", 0.9, "o0", None)], f"image int, entity string, text string, score double, source_id string, box {G.BOX}")
    exact = spark.createDataFrame([(1, "No", " ABC123", "CERT", 0.98, ["o0"], None, "label")], f"image int, label string, value string, field_type string, confidence double, ids array<string>, box {G.BOX}, reason string")
    key = ["screen"]
    shown = U.model_evidence(*[df.withColumnRenamed("image", "screen") for df in (images.where("image < 3"), items, found, exact, fused.where("image = 1"))], key)
    return shown.select("screen", *[F.to_json(c).alias(c) for c in ("items", "model_candidates", "exact_candidates", "fused_candidates")])


_BOX_JSON = '"box":{"x1":0.0,"y1":0.0,"x2":9.0,"y2":9.0}'
_SHOWN = (
    (1, '[{"id":"o0","text":"","confidence":0.9},{"id":"o1","text":"b c",' + _BOX_JSON + ',"confidence":0.5}]', '[{"source_id":"o0","entity":"CERT","text":"ABC123","score":0.9}]', '[{"ids":["o0"],"label":"No","value":"ABC123","field_type":"CERT","confidence":0.98,"reason":"label"}]',
     '[{"candidate_id":"c0","ids":["o0"],"text":"ABC123","types":["CERT"],"sources":["ner"],"confidence":0.9,' + _BOX_JSON + "}]"),
    (2, "[]", "[]", "[]", "[]"),
)
SQL["l23_cases"] = "SELECT CAST(screen AS INT) AS screen, items, model_candidates, exact_candidates, fused_candidates FROM (" + values(_SHOWN, "screen, items, model_candidates, exact_candidates, fused_candidates") + ")"

QUERIES |= {f.__name__: f for f in (p_cases, r1_cases, r3_cases, w_cases, l7_cases, j1_cases, w3_cases, k2_cases, v6_cases, t9_cases, a2_cases, t13_cases, c3_cases, m3_cases, m15_cases, k7_cases, l16_cases, v21_cases, m7_cases, m8_cases, m9_cases, l19_cases, a10_cases, a10_task_cases, l18_cases, l23_cases)}
