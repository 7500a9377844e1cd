"""Labels and the values beside them: vocabularies of labels, matching, association on a page."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validators as V
from ..functions.spans import once

# Labels of sensitive fields and their types.
FIELD_LABELS = (
    ("Certificate No", "CERTIFICATE_NUMBER"), ("Certificate Number", "CERTIFICATE_NUMBER"), ("Cert No", "CERTIFICATE_NUMBER"), ("Cert Number", "CERTIFICATE_NUMBER"),
    ("Certificate No.", "CERTIFICATE_NUMBER"), ("Registration No", "REGISTRATION_NUMBER"), ("Registration Number", "REGISTRATION_NUMBER"), ("Reg No", "REGISTRATION_NUMBER"),
    ("Application No", "APPLICATION_NUMBER"), ("Application Number", "APPLICATION_NUMBER"), ("Application ID", "APPLICATION_ID"), ("Student ID", "STUDENT_ID"),
    ("Student Number", "STUDENT_ID"), ("Roll No", "ROLL_NUMBER"), ("Roll Number", "ROLL_NUMBER"), ("Admission No", "ADMISSION_NUMBER"), ("Admission Number", "ADMISSION_NUMBER"),
    ("Employee ID", "EMPLOYEE_ID"), ("Employee Number", "EMPLOYEE_ID"), ("Password", "PASSWORD"), ("Gate Pass", "PASSWORD"), ("Passport No", "PASSPORT_NUMBER"),
    ("Passport Number", "PASSPORT_NUMBER"), ("License No", "LICENSE_NUMBER"), ("Licence No", "LICENSE_NUMBER"), ("Policy Number", "POLICY_NUMBER"), ("Policy No", "POLICY_NUMBER"),
    ("Reference Number", "REFERENCE_NUMBER"), ("Reference No", "REFERENCE_NUMBER"), ("Document Number", "DOCUMENT_NUMBER"), ("Document No", "DOCUMENT_NUMBER"),
    ("Serial Number", "SERIAL_NUMBER"), ("Serial No", "SERIAL_NUMBER"), ("Date of Birth", "DATE_OF_BIRTH"), ("DOB", "DATE_OF_BIRTH"), ("Email", "EMAIL"), ("Email Address", "EMAIL"),
    ("Phone", "PHONE"), ("Phone Number", "PHONE"), ("Mobile", "PHONE"), ("Mobile Number", "PHONE"), ("Account Number", "ACCOUNT_NUMBER"), ("Account No", "ACCOUNT_NUMBER"),
    ("Card Number", "CARD_NUMBER"), ("UPI ID", "UPI_ID"), ("IFSC", "IFSC"), ("IBAN", "IBAN"),
)
# Labels of secrets on pages, in order, and their types.
SECRET_LABELS = (
    (("password", "passwd", "pwd", "passcode", "gate pass"), "PASSWORD"), (("one time password", "one-time password", "otp"), "OTP"), (("pin number", "pin"), "PIN"),
    (("email address", "e-mail", "email"), "EMAIL_ID"), (("phone number", "mobile number", "contact number", "telephone", "mobile", "phone"), "PHONE_NUMBER"),
    (("upi id", "upi", "vpa"), "UPI_VPA"), (("account number", "account no", "acct"), "BANK_ACCOUNT"), (("card number",), "CARD_NUMBER"), (("ifsc",), "IFSC_CODE"),
    (("date of birth", "birth date", "dob"), "DATE_OF_BIRTH"), (("aadhaar", "aadhar", "uidai"), "AADHAAR"), (("passport number", "passport no"), "PASSPORT_NUMBER"),
)


def _key(label: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[.\-_:;/\\]+", " ", label.lower().replace("0", "o"))).strip()


#: Longest key first, so that the most specific label wins.
_BY_LENGTH = sorted(((_key(a), a, b) for a, b in FIELD_LABELS), key=lambda x: -len(x[0]))
#: A text whose key is longer covers no label.
LONGEST = int(len(_BY_LENGTH[0][0]) / 0.4)
#: What a key has that holds a label, and one that differs from a label in two places at most: of
#: the label's three parts one at least is the same at the same place.
_HOLDS = "|".join(re.escape(k) for k, _, _ in _BY_LENGTH)
_NEAR = "^(?:" + "|".join(sorted({f".{{{i}}}{re.escape(k[i:j])}" for k, _, _ in _BY_LENGTH if len(k) >= 6 for i, j in ((len(k) * p // 3, len(k) * (p + 1) // 3) for p in range(3))})) + ")"
#: The vocabularies are arrays of rows, so that one expression serves all entries.


def _vocabulary(rows: list[tuple[str, str, str]]) -> Column:
    return F.from_json(F.lit(json.dumps([{"key": k, "label": label, "type": kind} for k, label, kind in rows])), "array<struct<key:string,label:string,type:string>>")


def _hit(entry: Column, weak: bool) -> Column:
    return F.when(entry.isNotNull(), F.struct(entry.label.alias("label"), entry.type.alias("type"), F.lit(weak).alias("weak")))


def _first(rows: Column) -> Column:
    return F.get(rows, F.lit(0))


def field_label(text: Column) -> Column:
    """The label of a sensitive field that a text is: struct(label, type, weak false) or null.

    In order of length: equal, or one within the other with 0.4 of the longer's length (a text
    inside a label has three characters at least); else up to two places differ, for labels of six
    characters or more. White space, punctuation, case and 0 for o do not matter.
    """
    key = T.label_key(text)
    n = F.length(key)

    def fits(e: Column) -> Column:
        size = F.length(e.key)
        return (key == e.key) | (key.contains(e.key) & (size / n >= 0.4)) | (e.key.contains(key) & (n >= 3) & (n / size >= 0.4))

    def close(e: Column) -> Column:
        size = F.length(e.key)
        differ = F.size(F.filter(F.zip_with(F.split(key, ""), F.split(e.key, ""), lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
        near = (size >= 6) & (F.abs(n - size) <= 2)
        return F.when(near, differ <= 2).otherwise(False)

    words = _vocabulary(_BY_LENGTH)
    may = key.rlike(_HOLDS) | F.lit("|".join(k for k, _, _ in _BY_LENGTH)).contains(key) | key.rlike(_NEAR)
    return F.when(n.between(3, LONGEST) & may, F.coalesce(_hit(_first(F.filter(words, fits)), False), _hit(_first(F.filter(words, close)), False)))


def field_label_weak(text: Column) -> Column:
    """An equal label, or else the longest label that a longer text (under 0.4) merely mentions."""
    key = T.label_key(text)
    n = F.length(key)
    words = _vocabulary(_BY_LENGTH)
    exact = F.filter(words, lambda e: key == e.key)
    weak = F.filter(words, lambda e: key.contains(e.key) & (F.length(e.key) / n < 0.4))
    return F.when(n > 0, F.coalesce(_hit(_first(exact), False), _hit(_first(weak), True)))


def secret_label(text: Column) -> Column:
    """The first entry of the secrets' labels that a text holds as words: one with 0.4 of the
    text's length (or equal) before a weak one."""
    key = T.secret_key(text)
    n = F.length(key)
    rows = [(r"(?<![a-z0-9_])(" + "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True)) + r")(?![a-z0-9_])", "", kind) for labels, kind in SECRET_LABELS]
    found = F.filter(
        F.transform(_vocabulary(rows), lambda e: F.struct(e.key.alias("key"), F.call_function("regexp_extract", key, e.key, F.lit(1)).alias("label"), e.type.alias("type"))),
        lambda e: e.label != "",
    )
    strong = F.filter(found, lambda e: F.length(e.label) / n >= 0.4)
    anything = key.rlike("|".join(re.escape(x) for labels, _ in SECRET_LABELS for x in labels))
    return F.when((n > 0) & anything, F.coalesce(_hit(_first(strong), False), _hit(_first(found), True)))


def same_line(df: DataFrame, text: str = "text") -> DataFrame:
    """df with label, field_type, value and confidence of texts such as "Label: value".

    Split at a colon, a dash with a space, or two spaces, the first split whose left side is a label
    counts (0.98), or a mention of one whose value has the type's shape (0.90). Null without.
    """
    raw = F.col(text)
    split = lambda p: F.struct(F.regexp_extract(raw, p, 1).alias("left"), F.trim(F.regexp_extract(raw, p, 2)).alias("right"))
    parts = F.filter(F.array(*map(split, (r"^(.+?):\s*(.+)$", r"^(.+?[.:]?\s*[-–—]+)\s+(.+)$", r"^(.+?)\s{2,}(.+)$"))), lambda x: (x.left != "") & (x.right != ""))
    out = once(df, "veil_parts", F.when(raw.rlike(r":|[-–—]\s|\s{2}"), parts))
    hits = F.transform("veil_parts", lambda x: F.struct(x.right.alias("right"), field_label(x.left).alias("strong"), F.when(V.plausible_value(x.right), field_label_weak(x.left)).alias("weak")))
    out = once(out, "veil_hits", hits)
    good = F.filter("veil_hits", lambda h: h.strong.isNotNull() | F.coalesce(V.field_value_passes(h.weak.type, h.right), F.lit(False)))
    hit = once(out, "veil_hit", _first(good))
    h = F.coalesce("veil_hit.strong", "veil_hit.weak")
    found = F.struct(h.label.alias("label"), h.type.alias("type"), T.clean(F.col("veil_hit.right")).alias("value"), F.when(F.col("veil_hit.strong").isNotNull(), 0.98).otherwise(0.9).alias("confidence"))
    ok = F.col("veil_hit").isNotNull() & V.plausible_value(F.col("veil_hit.right"))
    return once(hit, "found", F.when(ok, found)).drop("veil_parts", "veil_hits", "veil_hit")


# --- on a page, in order: plain Python within the page's own pass --------------------------------

_SECRET_RE = [(re.compile(r"\b(?:" + "|".join(re.escape(x) for x in sorted(ls, key=len, reverse=True)) + r")\b", re.ASCII), kind) for ls, kind in SECRET_LABELS]
#: What a value must hold to go with a mere mention of a label (None: nothing will do).
_SHAPES = {
    "PASSWORD": lambda v: "@" in v or (len(v) >= 6 and bool(re.search("[a-zA-Z]", v)) and bool(re.search("[0-9]", v))),
    "EMAIL_ID": lambda v: "@" in v,
    "PHONE_NUMBER": lambda v: len(re.sub("[^0-9]", "", v)) >= 7,
    "CARD_NUMBER": lambda v: bool(re.search("[0-9]{4}", v)),
    "IFSC_CODE": lambda v: bool(re.fullmatch(r"(?i)[A-Z]{4}0[A-Z0-9]{6}", v)),
}
#: A row of mask signs, as shown beside a value; how far values may be from their labels.
MASK = re.compile(r"[\u2022*]{4,}")
SKIPS, CROSSING, DOTS_AHEAD, SHORT = 3, 6, 3, 20


def _normal(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[.\-_:;/\\]+", " ", (text or "").lower())).strip()


def find_secret(text: str) -> tuple[str, str, bool] | None:
    """(label, type, weak) of the label of a secret that a text names; see secret_label()."""
    key, found = _normal(text), []
    for pattern, kind in _SECRET_RE if key else ():
        if m := pattern.search(key):
            found.append((m[0], kind, len(m[0]) < 0.4 * len(key)))
    return min(found, key=lambda hit: hit[2], default=None)


def plausible(value: str) -> bool:
    """Whether a text may be a value: see validators.plausible_value_dom()."""
    v = value.strip()
    words = v.split()
    if not 2 <= len(v) <= 80 or not re.search(r"(?i)[a-z0-9]", v) or len(words) > 8:
        return False
    return not (len(words) > 4 and re.fullmatch(r"(?i)[a-z\s.,?()'\"]+", v) and not re.search(r"[0-9@/_-]", v))


def bare_label(text: str) -> tuple[str, str, bool] | None:
    """The label that a short text is, if no value is left beside it."""
    key = _normal(text)
    hit = find_secret(key) if len(key) <= 60 else None
    if not hit or hit[2] or plausible(re.sub(r"[:\s]+", " ", key.replace(hit[0], "", 1)).strip()):
        return None
    return hit


def label_and_value(text: str) -> tuple[str, str, tuple[str, str, bool]] | None:
    """The two sides of "Label: value" (any colon, or two spaces) and the label's hit.

    A label that is only mentioned counts where the value has its type's shape; a value that is
    itself nothing but a label does not count.
    """
    m = re.match(r"(.+?)\s*[:\uff1a]\s*(.+)$", text) or re.match(r"(.+?)\s{2,}(.+)$", text)
    label, value = (m[1].strip(), m[2].strip()) if m else ("", "")
    hit = find_secret(label) if 0 < len(label) <= 60 else None
    if not hit or not plausible(value) or (hit[2] and not _SHAPES.get(hit[1], lambda v: False)(value)):
        return None
    other = find_secret(value)
    if other and not plausible(value.replace(other[0], "", 1)):
        return None
    return label, value, hit


def _scope(seg: dict) -> str:
    """The container that a segment's element stands in (a text's is one part nearer)."""
    parts = ["html", "body", *filter(None, seg["dom_path"].split("/"))] + ["#text"] * (seg["kind"] == "text")
    return "/".join(parts[:-2] if len(parts) > 2 else parts)


def _row(path: str) -> str:
    m = re.match(r"(.*/tr\[[0-9]+\])", path)
    return m[1] if m else ""


def _value_of(segments: list[dict], at: int) -> int | None:
    """Where the value of the bare label `at` stands, if it has one.

    A form value behind it is one. A text is one behind a label with a colon, or behind links and
    buttons only that were skipped; else only in another container and with mask signs near by. Up to
    SKIPS links, buttons and other labels are skipped, and short texts that are no values; a long
    one ends the search, as do CROSSING segments after the label's container was left.
    """
    scope, colon = _scope(segments[at]), segments[at]["text"].rstrip().endswith((":", "\uff1a"))
    links = labels = behind = 0
    left = masked = False
    for j in range(at + 1, len(segments)):
        seg = segments[j]
        if seg["kind"] == "form_value":
            return j
        if _scope(seg) != scope:
            left = True
        elif left:
            behind += 1
            if behind > CROSSING:
                return None
        text = seg["text"].strip()
        if MASK.search(text):
            masked = True
        elif text:
            skipped = links + labels
            if seg["tag"] in ("a", "button"):
                links += 1
            elif bare_label(text):
                labels += 1
            elif plausible(text):
                near = masked or any(MASK.search(s["text"]) for s in segments[j : j + DOTS_AHEAD + 1])
                return j if colon or (links and not labels) or (left and near) else None
            elif len(text) > SHORT:
                return None
            if links + labels > max(skipped, SKIPS):
                return None
    return None


def _forced(seg: dict, kind: str, reason: str) -> dict:
    return seg | {"force_redact": True, "force_reason": reason, "forced_type": kind}


def associate_labels(segments: list[dict]) -> list[dict]:
    """Segments of a page with the values of secrets' labels forced; labels stay as they are.

    A: a form value whose label or name names a secret. B: a text or attribute with label and value
    becomes two segments. C: a bare label's value is put behind it. D: in tables, a cell under such a
    header, and the cell beside one in its row. What is forced already stays as it is.
    """
    out: list[dict] = []
    taken: set[int] = set()
    for i, seg in enumerate(segments):
        if i in taken:
            continue
        if seg["kind"] == "form_value":
            names = [x for x in (seg["hint"].get("label_text"), seg["hint"].get("field_name")) if x and x.strip()]
            hit = None if seg["force_redact"] else find_secret(" ".join(names))
            out.append(_forced(seg, hit[1], f"label-hint-{hit[0].replace(' ', '-')}") if hit else seg)
        elif split := label_and_value(seg["text"]):
            label, value, hit = split
            out.append(seg | {"id": f"{seg.get('id') or f'seg_{i:04d}'}~label", "text": label})
            out.append(_forced(seg, hit[1], f"label-associated-split:{hit[0].replace(' ', '-')}") | {"id": f"{seg.get('id') or f'seg_{i:04d}'}~value", "text": value})
        else:
            out.append(seg)
            if hit := bare_label(seg["text"]):
                j = _value_of(segments, i)
                if j is not None and j not in taken:
                    taken.add(j)
                    out.append(_forced(segments[j], hit[1], f"label-associated-neighbor:{hit[0].replace(' ', '-')}"))
    return _in_tables(out)


def _in_tables(segments: list[dict]) -> list[dict]:
    """Cells under a header, or beside one in its row, that names a secret."""
    out, cells = list(segments), {}

    def force(j: int, hit: tuple[str, str, bool]) -> None:
        if not segments[j]["force_redact"] and j not in cells and plausible(segments[j]["text"]):
            cells[j] = _forced(segments[j], hit[1], f"label-associated-table:{hit[0].replace(' ', '-')}")

    for i, seg in enumerate(segments):
        if seg["force_redact"]:
            continue
        head = seg["hint"].get("table_header") or ""
        if (hit := find_secret(head)) and seg["tag"] != "th" and seg["text"].strip() != head.strip():
            force(i, hit)
        elif seg["tag"] == "th" and (hit := find_secret(seg["text"])) and (row := _row(seg["dom_path"])):
            for j in range(i + 1, len(segments)):
                if _row(segments[j]["dom_path"]) != row:
                    break
                if segments[j]["tag"] == "td" or segments[j]["kind"] == "form_value":
                    force(j, hit)
                    break
    for j, seg in cells.items():
        out[j] = seg
    return out
