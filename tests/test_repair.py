"""Filings whose headings mislead."""

from ledgerline.operators.markup import read_lines
from ledgerline.operators.repair import clean_filings, repaired_sections

LONG = [f"Sentence {k} tells what happened to sales and margins in region {k}." for k in range(60)]
p = lambda *xs: "".join(f"<p>{x}</p>" for x in xs)
run = lambda html, form="10-K": repaired_sections(read_lines(html), form)


def test_repeated_item_headers_are_joined():
    html = p(
        "Item 7. Discussion", *LONG[:20], "31", "Item 7. Discussion", *LONG[20:40], "32", "Item 7. Discussion",
        *LONG[40:], "Item 8. Statements", "x"
    )
    assert run(html)[0]["MD&A"] == "\n".join(["Discussion", *LONG])


def test_a_unique_anchor_outranks_length():
    html = p("Item 7. Discussion", *LONG, "Item 7A. Market") + '<p id="item_7_start">Item 7. Discussion</p>' + p(
        *LONG[:3], "Item 8. Statements", "x", "Item 7. See", "y", "Item 9. z"
    )
    assert run(html)[0]["MD&A"].startswith("Discussion\nSentence 0") and len(run(html)[0]["MD&A"]) > 2000
    short = p("Item 7. Discussion", "tiny", "Item 7A. Market") + '<p id="item_7_start">Item 7. Discussion</p>' + p(
        *LONG[:3], "Item 8. Statements", "x", "Item 7. See", *LONG[:9], "Item 9. z"
    )
    assert run(short)[0]["MD&A"] == "\n".join(["Discussion", *LONG[:3]])


def test_incorporation_stub_is_resolved_by_a_styled_title():
    html = p(
        "Item 7. Discussion", "Incorporated by reference.", "Item 8. Statements", "x", "Item 15. Exhibits"
    ) + "<h2>Management’s Discussion and Analysis</h2>" + p(*LONG) + "<h2>Financial Statements</h2>" + p("end")
    assert run(html)[0]["MD&A"] == "\n".join(["Management’s Discussion and Analysis", *LONG])


def test_a_title_in_prose_or_without_end_is_not_taken():
    plain = p(
        "Item 7. Discussion", "Incorporated by reference.", "Item 8. Statements", "x", "Item 15. Exhibits",
        "Management's Discussion and Analysis", *LONG, "Financial Statements"
    )
    found, failed = run(plain)
    assert found["MD&A"] == "Discussion\nIncorporated by reference." and failed["MD&A"] == "no other title was found"
    open_end = p(
        "Item 7. Discussion", "Incorporated by reference.", "Item 8. Statements", "x"
    ) + "<h2>Management's Discussion and Analysis</h2>" + p(*LONG)
    assert run(open_end)[1]["MD&A"] == "a title was found without a reliable end"


def test_late_index_points_to_earlier_text():
    index = p(
        "Part I", "Item 1. Business", "Item 1A. Risk", "Item 2. Properties", "Item 3. Legal", "Part II",
        "Item 5. Market", "Item 7. Discussion", "Item 7A. Quantity", "Item 8. Statements", "Item 9. Changes"
    )
    body = p(
        "Management's Discussion and Analysis", *LONG, "Risk Factors", *LONG[::-1], "Properties",
        *[f"filler {k}" for k in range(200)]
    )
    found, _ = run(body + index)
    assert found["MD&A"] == "\n".join(
        ["Management's Discussion and Analysis", *LONG]
    ) and found["Risk Factors"] == "\n".join(["Risk Factors", *LONG[::-1]])


def test_accounting_notes_need_a_first_note():
    html = p(
        "Notes to Consolidated Financial Statements", "12", "Item 8. Statements", "see index", "Item 9. Changes",
        "none", "Notes to Consolidated Financial Statements", "Note 1. Basis", *LONG, "Signatures", "x"
    )
    found, _ = run(html)
    assert found["Notes"] == "\n".join(["Notes to Consolidated Financial Statements", "Note 1. Basis", *LONG])
    assert run(html.replace("Note 1. Basis", "Basis"))[0]["Notes"] == "Statements\nsee index"


def test_equally_long_candidates_keep_the_first_reading():
    one = p("Notes to Consolidated Financial Statements", "Note 1. Basis", *LONG, "Signatures")
    found, failed = run(p("Item 8. Statements", "see index", "Item 9. Changes") + one + one)
    assert found["Notes"] == "Statements\nsee index" and failed["Notes"] == "several texts remain possible"


def test_table_of_filings(spark):
    docs = spark.createDataFrame(
        [(1, "10-K", p("Item 7. D", "text")), (2, "10-K", None), (3, None, p("only text"))],
        "id long, form string, html string"
    )
    got = sorted((r.doc, r.section or "", r.text or "") for r in clean_filings(docs, "id", "form", "html").collect())
    assert got == [(1, "MD&A", "D\ntext"), (2, "", ""), (3, "Full Filing", "only text")]
