"""XML filings by namespace, recovery, and what is told of sections that are not there."""

import pytest

from ledgerline.operators import markup, repair

XHTML = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" {}><body>{}</body></html>'
INLINE = 'xmlns:inline="http://www.xbrl.org/2013/inlineXBRL" xmlns:x="http://www.xbrl.org/2003/instance"'


def text(body, names=INLINE):
    return markup.visible_text(XHTML.format(names, body))


def test_hidden_vocabulary_goes_by_namespace_not_prefix():
    body = "<inline:header><p>secret</p></inline:header><p>one</p><inline:hidden>two</inline:hidden><x:context>three</x:context><p><inline:nonNumeric>four</inline:nonNumeric></p>"
    assert text(body) == "one\nfour"
    # the same prefix with another meaning is visible
    assert text("<ix:header><p>shown</p></ix:header>", 'xmlns:ix="http://example.org/other"') == "shown"
    assert text("<ix:hidden>a</ix:hidden><p>b</p>", 'xmlns:ix="http://www.xbrl.org/2008/inlineXBRL"') == "b"


def test_xml_text_entities_and_empty_elements():
    assert text("<p>a&nbsp;b &amp; c &eacute;</p><p><![CDATA[d < e &nbsp;]]></p>") == "a b & c é\nd < e &nbsp;"
    assert text("<p/>one<br/>two<script>x</script><div hidden='hidden'>three</div><div style='display : none'>four</div><p>five</p>") == "one\ntwo\nfive"
    assert text("<svg xmlns='http://www.w3.org/2000/svg'><text>drawn</text></svg><p>six</p>") == "six"
    assert text("") == ""


@pytest.mark.parametrize("broken", [
    XHTML.format(INLINE, "<p>one<p>two</p>"), XHTML.format(INLINE, "<p>one</p> & <p>two</p>"), XHTML.format("", "<ix:x>one</ix:x><p>two</p>"),
    XHTML.format(INLINE, "<p>one</p><p>two</p>").replace("<html", '<!DOCTYPE html [<!ENTITY a "b">]><html'), XHTML.format(INLINE, "<p>one</p><p>two")[:-14],
])
def test_what_is_not_well_formed_is_read_as_html(broken):
    found = markup.visible_text(broken)
    assert "one" in found and "two" in found and "<" not in found


def test_signs_of_xml_are_looked_for_in_the_beginning():
    assert markup.says_xml("﻿ \n<?XML version='1.0'?>") and markup.says_xml('<html xmlns:ix="u">') and markup.says_xml("<body><ix:x>")
    assert not markup.says_xml("<html>" + " " * 5000 + "<ix:x>") and not markup.says_xml("")


def test_pagination_and_grids_go_in_xhtml_too():
    rows = "".join(f"<tr><td>{n}</td><td>{k},353</td><td>{k},045</td><td>{k}%</td></tr>" for k, n in enumerate(("Americas", "Europe", "Total")))
    body = f"<p>We invested $12.5 billion.</p><table><tr><th>Segment</th><th>2025</th><th>2024</th><th>Change</th></tr>{rows}</table><p>Growth followed.</p>"
    assert text(body) == "We invested $12.5 billion.\nGrowth followed."


def filing(body, form="10-K"):
    lines = markup.read_lines(f"<html><body>{body}</body></html>")
    found, failed = repair.repaired_sections(lines, form)
    return repair.diagnosed(lines, form, found, failed)


def long(words):
    return f"<p>{words} {'The company operates in markets that change. ' * 60}</p>"


def test_reasons_for_thin_and_absent_sections():
    body = "<h2>Item 1A. Risk Factors</h2>" + long("Demand") + "<h2>Item 1B. Staff</h2><h2>Item 7. Management's Discussion and Analysis</h2><p>Short.</p><h2>Item 7A. Market</h2><h2>Overview</h2><h2>overview </h2>"
    notes = {n: (size, reason) for n, size, reason, _ in filing(body)}
    assert set(notes) == {"MD&A", "Notes"}
    assert notes["Notes"][0] == 0 and 0 < notes["MD&A"][0] < repair.SUBSTANTIAL
    shown = filing(body)[0][3]
    assert "Overview" in shown and len([h for h in shown if h.lower().strip() == "overview"]) == 1 and shown == sorted(shown, key=str.lower)


def test_content_in_a_companion_document():
    body = "<h2>Item 7. Management's Discussion and Analysis</h2><p>The Annual Report to Shareholders is incorporated into this Item by reference.</p><h2>Item 7A. Market</h2>"
    last = filing(body)[-1]
    assert last[0] is None and last[2] == "content is in a companion document"
    assert all(n is not None for n, *_ in filing(body.replace("Annual Report", "Report")))


def test_one_reading_gives_texts_and_notes(spark):
    html = "<h2>Item 1A. Risk Factors</h2>" + long("Demand") + "<h2>Item 1B. Staff</h2>"
    docs = spark.createDataFrame([(1, "10-K", html), (2, "10-Q", None), (3, "8-K", "<p>news</p>"), (4, None, "<p>x</p>")], "id long, form string, html string")
    rows = repair.tagged_filings(docs, "id", "form", "html").collect()
    kinds = sorted((r.doc, r.kind, r.section or "") for r in rows)
    assert kinds == [
        (1, "note", "MD&A"), (1, "note", "Notes"), (1, "section", "Risk Factors"), (2, "note", "MD&A"), (2, "note", "Notes"), (2, "note", "Risk Factors"), (2, "section", ""),
        (3, "section", "Full Filing"), (4, "section", "Full Filing"),
    ]
    assert all(r.size == len(r.text or "") for r in rows if r.kind == "section") and all(r.reason for r in rows if r.kind == "note")
    assert repair.tagged_filings(docs.limit(0), "id", "form", "html").collect() == []
