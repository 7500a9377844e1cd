"""Pages as segments: visible text, attributes and form values in document order.

One pass of the standard library's parser a page, in Arrow batches; everything that belongs to a
page (label resolution, table headers) is resolved in that pass, so that no shuffle is needed.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SEGMENTS = (
    "page_id long, seg_ord int, id string, kind string, tag string, attr string, text string, block_role string, force_redact boolean, force_reason string, forced_type string, "
    "hint struct<label_text:string,autocomplete_type:string,field_name:string,table_header:string>, dom_path string, href string, input_type string, in_form boolean"
)

# What is never captured, which attributes are, and how deep a path goes.
IGNORED = {"script", "style", "noscript", "template", "svg", "canvas"}
ATTRIBUTES = ("aria-label", "alt", "title", "placeholder")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DEPTH = 24
# Autocomplete tokens and the types they hint at; those that are always redacted.
AUTOCOMPLETE = {
    "email": "EMAIL_ID", "username": "USERNAME", "current-password": "PASSWORD", "new-password": "PASSWORD", "tel": "PHONE_NUMBER", "tel-country-code": "PHONE_NUMBER",
    "tel-national": "PHONE_NUMBER", "cc-number": "CARD_NUMBER", "cc-csc": "PASSWORD", "cc-exp": "DATE_OF_BIRTH", "bday": "DATE_OF_BIRTH", "street-address": "STREET_ADDRESS",
    "address-line1": "STREET_ADDRESS", "address-line2": "STREET_ADDRESS", "postal-code": "POSTAL_CODE", "country": "COUNTRY", "name": "PERSON_NAME", "given-name": "PERSON_NAME",
    "family-name": "PERSON_NAME", "nickname": "PERSON_NAME", "organization": "ORGANIZATION", "cc-name": "PERSON_NAME", "transaction-amount": "BANK_ACCOUNT",
}
FORCED_AUTOCOMPLETE = ("current-password", "new-password", "cc-csc", "cc-number")


def sensitive_field(tag: str, input_type: str | None, autocomplete: str | None) -> str | None:
    """Why a form control's value is always redacted, or None."""
    if tag not in ("input", "textarea", "select"):
        return None
    kind = (input_type or "").strip().lower()
    if kind in ("password", "hidden"):
        return f"input-type-{kind}"
    token = ((autocomplete or "").split() or [""])[-1].lower()
    return f"autocomplete-{token}" if token in FORCED_AUTOCOMPLETE else None


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Node:
    __slots__ = ("attrs", "cells", "children", "header", "hidden", "label", "options", "path", "table", "tag", "text")

    def __init__(self, tag, attrs, path, hidden):
        self.tag, self.attrs, self.path, self.hidden = tag, attrs, path, hidden
        self.children, self.cells, self.header, self.table = {}, 0, {}, None
        self.label, self.text, self.options = None, [], []


class _Walker(HTMLParser):
    """Builds segments in document order: an element's form value, its attributes, its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Node("#root", {}, "", False)]
        self.segments: list[dict] = []
        self.labels: dict[str, list[str]] = {}  # for id -> texts
        self.by_id: dict[str, list[str]] = {}
        self.controls: list[tuple[dict, _Node, _Node | None]] = []
        self.elements: list[tuple[_Node, bool]] = []  # interactive ones, and whether a form holds them
        self.pending: list[str] = []
        self.in_body = False
        self.select: tuple[dict, list] | None = None

    def _emit(self, node: _Node, kind: str, text: str, attr: str | None = None) -> dict | None:
        seg = {
            "kind": kind, "tag": node.tag, "attr": attr, "text": text, "force_redact": False, "force_reason": None, "forced_type": None, "dom_path": node.path,
            "hint": {}, "href": node.attrs.get("href"), "input_type": node.attrs.get("type"), "in_form": any(n.tag == "form" for n in self.stack),
        }
        cell = next((n for n in reversed(self.stack) if n.tag in ("td", "th")), None)
        if cell is not None and cell.tag == "td" and cell.table is not None and (head := cell.table.header.get(cell.cells)):
            seg["hint"]["table_header"] = head
        self.segments.append(seg)
        return seg

    def _flush(self):
        node = self.stack[-1]
        if self.pending:
            text = _clean("".join(self.pending))
            self.pending = []
            if text and node.tag == "#root":
                self.in_body = True  # text before any tag of a body
            if text and self.in_body and not node.hidden:
                for n in self.stack:
                    n.text.append(text)
                self._emit(node, "text", text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        attrs = dict(attrs)
        up = self.stack[-1]
        if tag in ("html", "head"):
            return
        if tag == "body":
            self.in_body = True
            return
        up.children[tag] = up.children.get(tag, 0) + 1
        parts = (up.path.split("/") if up.path else []) + [f"{tag}[{up.children[tag]}]"]
        hidden = up.hidden or tag in IGNORED or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"
        node = _Node(tag, attrs, "/".join(parts[-DEPTH:]), hidden)
        if tag in ("td", "th"):
            row = next((n for n in reversed(self.stack) if n.tag == "tr"), None)
            node.table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if row is not None:
                node.cells = row.cells
                row.cells += 1
        if not self.in_body and tag not in ("title", "meta", "link", "style", "script", "base", "noscript"):
            self.in_body = True  # a body without its tag
        self.stack.append(node)
        if _interactive(tag, attrs) and not any(n.tag in ("script", "style", "noscript") for n in self.stack):
            self.elements.append((node, any(n.tag == "form" for n in self.stack[:-1])))
        if self.in_body and not hidden:
            value = attrs.get("value") if tag == "input" else None
            if tag in ("input", "textarea", "select"):
                seg = self._emit(node, "form_value", value or "")
                why = sensitive_field(tag, attrs.get("type"), attrs.get("autocomplete"))
                if why:
                    seg["force_redact"], seg["force_reason"] = True, why
                token = ((attrs.get("autocomplete") or "").split() or [""])[-1].lower()
                seg["hint"]["autocomplete_type"] = AUTOCOMPLETE.get(token)
                seg["hint"]["field_name"] = attrs.get("name")
                self.controls.append((seg, node, next((n for n in reversed(self.stack[:-1]) if n.tag == "label"), None)))
                if tag == "select":
                    self.select = (seg, [])
            if tag == "option" and self.select and "selected" in attrs:
                self.select[1].append(node)
            for name in ATTRIBUTES:
                if _clean(attrs.get(name) or ""):
                    self._emit(node, "attribute", _clean(attrs[name]), name)
        if tag in VOID:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.stack) > 1 and self.stack[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag in ("html", "head", "body") or not any(n.tag == tag for n in self.stack[1:]):
            return
        while len(self.stack) > 1:
            node = self.stack.pop()
            text = _clean(" ".join(node.text))
            if node.tag == "label":
                node.label = text
                if node.attrs.get("for"):
                    self.labels.setdefault(node.attrs["for"], []).append(text)
            if node.attrs.get("id"):
                self.by_id.setdefault(node.attrs["id"], []).append(text)
            if node.tag == "th" and node.table is not None:
                node.table.header.setdefault(node.cells, text)
            if node.tag == "option":
                for n in self.stack:
                    if n.tag == "select":
                        n.options.append(node.attrs.get("value") or text)
            if node.tag == "textarea":
                for seg, n, _ in self.controls:
                    if n is node:
                        seg["text"] = text
            if node.tag == "select" and self.select:
                self.select[0]["text"] = ", ".join(_clean(" ".join(n.text)) for n in self.select[1])
                self.select = None
            if node.tag == tag:
                break

    def handle_data(self, data):
        if not self.stack[-1].hidden:
            self.pending.append(data)

    def done(self) -> list[dict]:
        self._flush()
        while len(self.stack) > 1:
            self.handle_endtag(self.stack[-1].tag)
        for seg, node, wrapped in self.controls:
            if node.attrs.get("id") and self.labels.get(node.attrs["id"]):
                seg["hint"]["label_text"] = " ".join(self.labels[node.attrs["id"]])
            elif wrapped is not None:
                seg["hint"]["label_text"] = wrapped.label or _clean(" ".join(wrapped.text))
            elif node.attrs.get("aria-labelledby"):
                texts = [t for i in node.attrs["aria-labelledby"].split() for t in self.by_id.get(i, [])]
                seg["hint"]["label_text"] = " ".join(texts) or None
        # an element gives each of its segments once, so none is there twice
        return [seg for seg in self.segments if seg["kind"] != "form_value" or seg["text"]]


def _interactive(tag: str, attrs: dict) -> bool:
    """Links with a target, controls, and what has the role of a link or button, unless hidden."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (tag == "input" and (attrs.get("type") or "").strip().lower() == "hidden"):
        return False
    return bool(attrs.get("href")) if tag == "a" else tag in ("button", "input", "textarea", "select") or attrs.get("role") in ("button", "link")


def _role(tag: str, attrs: dict) -> str:
    if attrs.get("role") in ("button", "link"):
        return attrs["role"]
    kind = (attrs.get("type") or "").strip().lower()
    named = {"a": "link", "button": "button", "select": "combobox", "textarea": "textbox", "input": kind if kind in ("checkbox", "radio") else "textbox"}
    return named.get(tag, tag)


ELEMENTS = (
    "page_id long, ref string, tag string, role string, label string, text string, input_type string, is_submit boolean, has_form boolean, options array<string>, "
    "dom_path string, id_attr string, name_attr string"
)


def page_elements(html: str | None) -> list[dict]:
    """Interactive elements of a page in order, once for each path and tag, with refs el_1, el_2 ...

    Its label is the first of: aria-label, the label for its id, its text, its value, placeholder,
    name or title; 60 characters of it. A button without a type submits the form that holds it.
    """
    walker = _Walker()
    walker.feed(html or "")
    walker.close()
    walker.done()
    out, seen = [], set()
    for node, in_form in walker.elements:
        a, text = node.attrs, _clean(" ".join(node.text))
        if (node.path, node.tag) in seen:
            continue
        seen.add((node.path, node.tag))
        names = [a.get("aria-label"), *walker.labels.get(a.get("id") or "", [])[:1], text, *(a.get(n) for n in ("value", "placeholder", "name", "title"))]
        control = node.tag in ("input", "textarea", "select")
        kind = {"input": (a.get("type") or "text").strip().lower(), "textarea": "textarea", "select": "select"}.get(node.tag, "")
        typed = (a.get("type") or "").strip().lower()
        submits = kind in ("submit", "image") if node.tag == "input" else node.tag == "button" and (typed == "submit" if typed else in_form)
        out.append(
            {
                "ref": f"el_{len(out) + 1}", "tag": node.tag, "role": _role(node.tag, a), "label": next((x.strip()[:60] for x in names if x and x.strip()), ""), "text": "" if control else text[:120],
                "input_type": kind, "is_submit": submits, "has_form": in_form or node.tag == "form", "options": node.options if node.tag == "select" else None,
                "dom_path": node.path, "id_attr": a.get("id"), "name_attr": a.get("name"),
            }
        )
    return out


def elements(pages: DataFrame) -> DataFrame:
    """A row for each interactive element of pages (page_id, html)."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for batch in batches:
            rows = [e | {"page_id": page} for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in page_elements(html)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    made = StructType.fromDDL(ELEMENTS)
    return pages.select("page_id", "html").mapInArrow(run, made)


def page_segments(html: str | None) -> list[dict]:
    """Segments of a page in order; none for null or empty pages, malformed ones as far as read."""
    walker = _Walker()
    walker.feed(html or "")
    walker.close()
    return walker.done()


# What block a tag stands for is in functions.text.BLOCK_ROLES.
def segments(pages: DataFrame, associate: bool = False) -> DataFrame:
    """A row for each segment of pages (page_id, html). With `associate`, values beside labels of
    secrets are forced (operators.associate)."""

    def run(batches):
        from ..functions.text import BLOCK_ROLES
        from ..operators.associate import associate_labels

        names = [f.split()[0] for f in re.sub(r"struct<[^>]*>", "x", SEGMENTS).split(", ")]
        hint = pa.struct([(n, pa.string()) for n in ("label_text", "autocomplete_type", "field_name", "table_header")])
        kinds = {"page_id": pa.int64(), "seg_ord": pa.int32(), "force_redact": pa.bool_(), "in_form": pa.bool_(), "hint": hint}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            rows = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = page_segments(html)
                if associate:
                    found = associate_labels(found)
                for i, seg in enumerate(found):
                    h = {k: seg["hint"].get(k) for k in ("label_text", "autocomplete_type", "field_name", "table_header")}
                    rows.append(seg | {"page_id": page, "seg_ord": i, "id": seg.get("id") or f"seg_{i:04d}", "block_role": BLOCK_ROLES.get(seg["tag"], "inline"), "hint": h if any(h.values()) else None})
                if len(rows) > 20000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select("page_id", "html").mapInArrow(run, SEGMENTS)
