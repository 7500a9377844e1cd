from pyspark.sql import functions as F

from veilframe.operators import associate as A
from veilframe.operators import pages as P
from veilframe.sources.html import page_segments, segments

PAGE = """<!DOCTYPE html><html><head><title>x</title></head><body><h1>Login</h1><p>Write to john@site.org</p>
<form><label for="pw">Password</label><input id="pw" type="text" value="hunter2secret"><input type="password" value="abc"><input type="hidden" value="tok"></form>
<div>Password:</div><div>hunter3secret</div><p>Password: hunter4secret</p><div hidden>gone</div><script>var a = "gone2";</script>
<table><tr><th>Phone</th><td>+1 555 014 2288</td></tr></table><h2>Password</h2><p>This is a text about secrets, nothing more to say here.</p><img alt="a cat"></body></html>"""


def redacted(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return P.read_page(df).first()


def test_values_go_and_labels_stay(spark):
    row = redacted(spark, PAGE)
    text = row.sanitized_text
    for secret in ("hunter2secret", "hunter3secret", "hunter4secret", "abc", "tok", "john@site.org", "555 014", "gone"):
        assert secret not in text, secret
    for kept in ("Login", "Password", "Password: <PASSWORD>".split()[0], "This is a text about secrets", "a cat", "<EMAIL_ID>"):
        assert kept in text, kept
    assert set(row.findings[0].asDict()) == {"type", "source", "confidence", "segment_id", "force_redacted", "structural_hint"}


def test_segments_of_odd_pages(spark):
    assert page_segments(None) == [] and page_segments("") == []
    assert [s["text"] for s in page_segments("plain <b>text")] == ["plain", "text"]
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<p>a</p>")], "page_id long, html string")
    assert segments(df).count() == 1
    assert [r.status for r in P.read_page(df.where("page_id is not null")).orderBy("page_id").collect()] == ["error", "ok"]


def test_rebuild(spark):
    rows = [(1, 0, "A", "heading", "text"), (1, 1, "b", "paragraph", "text"), (1, 2, "c", "list_item", "text"), (1, 3, "d", "list_item", "text"), (1, 4, "e", "inline", "text"), (1, 5, "f", "inline", "text")]
    df = spark.createDataFrame(rows, "page_id long, seg_ord int, redacted string, block_role string, kind string")
    assert P.rebuild(df).first().document == "A\n\nb\n\nc\nd\n\ne f"


def test_table_header_and_select(spark):
    segs = page_segments("<table><thead><tr><th>Name</th><th>Password</th></tr></thead><tbody><tr><td>Ann</td><td>secret99</td></tr></tbody></table><select><option>a<option selected>b</select>")
    assert [s["hint"].get("table_header") for s in segs if s["tag"] == "td"] == ["Name", "Password"]
    assert [s["text"] for s in segs if s["kind"] == "form_value"] == ["b"]


def test_forced_placeholder(spark):
    df = spark.createDataFrame([("input-type-password", ""), ("autocomplete-cc-number", ""), ("label", "OTP"), ("label", "")], "r string, t string")
    assert [x[0] for x in df.select(P.forced_placeholder(F.col("r"), F.col("t"))).collect()] == ["<PASSWORD>", "<CARD_NUMBER>", "<OTP>", "<FORM_SECRET>"]


def test_deep_pages_keep_all_segments():
    inner = '<input value="one" title="a"><input value="two" title="b">'
    deep = "<div>" * 30 + inner + "</div>" * 30
    segs = page_segments(deep)
    assert [s["text"] for s in segs] == ["one", "a", "two", "b"]
    paths = [s["dom_path"].split("/") for s in segs]
    assert all(len(p) == 24 for p in paths) and [p[-1] for p in paths] == ["input[1]", "input[1]", "input[2]", "input[2]"]
    assert [s["text"] for s in page_segments(deep + deep)] == ["one", "a", "two", "b"] * 2


LONG_LABEL = "Your new account password for this site please"
#: Pages, what must not leave, and what must stay.
CASES = [
    ('<label for="a">Password</label><input id="a" value="abcdef">', "abcdef", "Password <PASSWORD>"),
    (f'<label for="a">{LONG_LABEL}</label><input id="a" value="hunter2secret">', "hunter2secret", LONG_LABEL),
    ('<input name="password" value="correct horse battery staple yes">', "battery", "<PASSWORD>"),
    ("<p>Password:</p><p>letmein</p>", "letmein", "Password: <PASSWORD>"),
    ("<div>Password:</div><div>s3cr3t-visible</div>", "s3cr3t", "<PASSWORD>"),
    ("<p>Password\uff1a hunter2x9</p>", "hunter2x9", "Password <PASSWORD>"),
    ('<img alt="gate pass: Tamluk2019">', "Tamluk2019", "gate pass <PASSWORD>"),
    ("<p>Password: hunter2secret</p>", "hunter2secret", "Password <PASSWORD>"),
    ("<table><tr><th>Password</th><td>table-secret-9</td></tr></table>", "table-secret", "Password <PASSWORD>"),
    ("<table><thead><tr><th>Password</th></tr></thead><tbody><tr><td>col-secret-7</td></tr></tbody></table>", "col-secret", "<PASSWORD>"),
    ('<div>Password</div><a href="/f">Forgot password?</a><div>madiwhfaoniof</div><div>\u2022\u2022\u2022\u2022\u2022</div><button>Hide password</button>', "madiwh", "<PASSWORD> Forgot password? Hide password"),
    ('<div><label for="pw">Password</label></div><div><span>mw1er2s3-live</span><span>********</span><button>Hide password</button></div>', "mw1er2s3", "<PASSWORD> Hide password"),
    ("<div><h2>Password</h2></div><div><p>Welcome back to your account</p></div>", "<PASSWORD>", "Welcome back to your account"),
    ("<span>Password</span><span>Just some prose without secrets</span>", "<PASSWORD>", "Just some prose without secrets"),
    ("<p>an email, just a filename: quarterly.pdf</p>", "<EMAIL_ID>", "an email, just a filename: quarterly.pdf"),
    ("<p>PIN:</p><p>OTP:</p><p>Email:</p><p>Phone:</p><p>Card number:</p><p>1234 5678</p>", "<PIN>", "PIN: OTP: Email:"),
    ("<p>Password:</p><p>This is a long text about secrets, nothing more to say in it</p><p>abc12345</p>", "<PASSWORD>", "abc12345"),
    ('<p>OTP</p><div><div><input value="993311"></div></div>', "993311", "<OTP>"),
    ("<p>Your IFSC is here: SBIN0001234</p>", "SBIN0001234", "Your IFSC is here"),
]


def test_association_cases(spark):
    df = spark.createDataFrame([(i, html) for i, (html, _, _) in enumerate(CASES)], "page_id long, html string")
    rows = {r.page_id: " ".join(r.sanitized_text.split()) for r in P.read_page(df).collect()}
    for i, (html, gone, kept) in enumerate(CASES):
        assert gone not in rows[i], (html, rows[i])
        for word in kept.split():
            assert word in rows[i], (html, rows[i])


def test_association_changes_values_only():
    before = page_segments("<p>Password:</p><p>letmein</p><p>x</p>")
    copies = [dict(s) for s in before]
    after = A.associate_labels(before)
    assert before == copies and [s["force_redact"] for s in after] == [False, True, False]
    assert A.find_secret("  Password: ") == ("password", "PASSWORD", False) and A.find_secret("UPI ID")[:2] == ("upi id", "UPI_VPA")
    assert A.find_secret("Contact us anytime") is None and A.find_secret(LONG_LABEL)[2] and not A.plausible("")
    assert A.plausible("mwafhaeiofhoeu") and not A.plausible("Thank you for reading this lengthy help article today")
