"""Captured pages: cases with known results, one table for each family."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from mailweave.functions import policy, subjects, text, urls
from mailweave.markup import headers, redact
from mailweave.markup.markdown import html_to_markdown, markdown
from mailweave.markup.quotes import strip_quotes
from mailweave.markup.tree import parse, table_rows
from mailweave.operators import attachments, captures, outcomes, threads
from mailweave.plans import capture

THREAD, ACCOUNT = "THREAD_REAL", "0"
HOME = "https://mail.google.com"

MARKDOWN = [
    ('<a href="https://ex.com/a">Docs</a>', "[Docs](https://ex.com/a)"),
    ('<a href="https://www.google.com/url?q=https%3A%2F%2Fex.com%2Fa&amp;sa=D">Docs</a>', "[Docs](https://ex.com/a)"),
    ('<a href="javascript:alert(1)">Click</a>', "Click"),
    ('<a href="https:evil">Click</a>', "Click"),
    ('<a href="https://ex.com/a_(b)">https://ex.com/a_(b)</a>', "https://ex.com/a_%28b%29"),
    ('<a href="https://ex.com/a_(b)">[Docs]</a>', "[\\[Docs\\]](https://ex.com/a_%28b%29)"),
    ('word<a href="https://ex.com/"> </a>next', "word next"),
    ('<a href="https://ex.com/x"></a>', "https://ex.com/x"),
    ('<img alt="logo" src="data:image/png;base64,AAAA">', "[inline image: logo]"),
    ('<img alt="x" src="https://ex.com/i.png">', "[image: x]"),
    ('<img src="https://ex.com/i.png">', "[image]"),
    ('<img width="1" height="1" src="https://x.com/p.gif">', ""),
    ('<img src="https://ci3.googleusercontent.com/meips/A=s0#https://x.com/email_open_log_pic.php">', ""),
    ('<img src="https://ssl.gstatic.com/ui/v1/icons/mail/images/pdf.gif" alt="pdf">', ""),
    ("<table><tr><td></td><td></td></tr><tr><td></td><td></td></tr></table>", ""),
    ("<table><tr><th>Item</th><th>Cost</th></tr><tr><td>a|b</td><td>$10</td></tr></table>", "| Item | Cost |\n| --- | --- |\n| a\\|b | $10 |"),
    ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", "a\nb"),
    ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>", "| 1 | 2 |\n| --- | --- |\n| 3 | |"),
    ("<ul><li>outer<ul><li>inner</li></ul></li></ul>", "- outer\n    - inner"),
    ("<ol><li>one<li>two</ol>", "1. one\n2. two"),
    ("<b>hi</b> <i>there</i>", "**hi** *there*"),
    ("<pre>before\n```\nafter</pre>", "````\nbefore\n```\nafter\n````"),
    ("<code>a`b</code>", "``a`b``"),
    ("<div>keep<script>bad()</script></div>", "keep"),
    ("Ready!<div>Next</div><div>More</div>", "Ready!\nNext\nMore"),
    ("<blockquote>old<br>words</blockquote>", "> old\n> words"),
    ("<blockquote><ul><li>a</li></ul></blockquote>", "- a"),
    ("a<hr>b<br>c", "a\n---\nb\nc"),
    ("<p>a   \u00a0 b</p>\n\n\n<p>c</p>", "a b\n c"),
    ("<p>x<b>y<p>z</p>w", "x**y**\n**z**\n**w**"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("html", "want"), MARKDOWN)
def test_markdown(html, want):
    assert html_to_markdown(html) == want


def test_markdown_of_deep_and_broken_pages():
    assert "end" in html_to_markdown("<div>" * 5000 + "end")
    assert html_to_markdown("<b><p>one</b>two</p><td>three<li>four") == "**one**two\nthree\n- four"


def stripped(html):
    root = parse(html)
    return strip_quotes(root), markdown(root)


LONG = "This is a substantial inline answer that must remain because it holds the sender's actual response and decision."


def test_quotes():
    assert stripped('<div>Reply text<blockquote class="gmail_quote">old stuff</blockquote></div>') == ((1, 0), "Reply text")
    assert stripped('<div>Reply text</div><div id="appendonsend"></div><div>quoted history</div>') == ((2, 0), "Reply text")
    assert stripped('<div>Hi</div><div class="gmail_signature">Kim</div>') == ((1, 0), "Hi")
    (_, kept), shown = stripped(f'<blockquote class="gmail_quote">&gt; First question<br>{LONG}<br>&gt; Second</blockquote>')
    assert kept == 1 and LONG in shown
    (removed, kept), shown = stripped(f'<div class="gmail_quote"><div class="gmail_attr">On Tue, Jane wrote:</div><blockquote>Old</blockquote><div>{LONG}</div></div>')
    assert (removed, kept) == (2, 1) and LONG in shown and "Old" not in shown


def head(html):
    return headers.header(table_rows(parse(f"<table>{html}<tr><td>Body</td></tr></table>").find(lambda n: n.tag == "table")))


def test_headers():
    date = "<td>Sun, Jun 14, 2026 at 7:51 AM</td>"
    got = head(f"<tr><td><b>Jen</b> jen@example.com</td>{date}</tr><tr><td>to: \"Doe, Jane\" &lt;jane@example.com&gt;, Moe &lt;moe@example.com&gt;</td></tr><tr><td>cc: legal@example.com</td></tr><tr><td>bcc: audit@example.com</td></tr>")
    assert got["to"] == [{"name": "Doe, Jane", "email": "jane@example.com"}, {"name": "Moe", "email": "moe@example.com"}]
    assert got["bcc"][0]["email"] == "audit@example.com" and got["issues"] == [] and got["date_raw"] == "Sun, Jun 14, 2026 at 7:51 AM"
    got = head(f"<tr><td><b>Tobias Weber</b> tw@example.com</td>{date}</tr><tr><td>An: Max &lt;max@example.de&gt;</td></tr>")
    assert got["from"] == {"name": "Tobias Weber", "email": "tw@example.com"} and got["to"] == [{"name": "Max", "email": "max@example.de"}] and not got["issues"]
    assert head(f'<tr><td><b>A</b> a@example.com</td>{date}</tr><tr><td>to: "Broken &lt;b@example.com</td></tr>')["issues"] == ["recipients"]
    assert head(f"<tr><td><b>A</b></td>{date}</tr><tr><td>to: a@example.com b@example.com</td></tr>")["issues"] == ["recipients"]
    assert head(f'<tr><td><b>A</b></td>{date}</tr><tr><td>to: "o@example.com" &lt;o@example.com&gt;</td></tr>')["issues"] == []
    assert head(f"<tr><td><b>A</b></td>{date}</tr><tr><td>to: S &lt;s@example.net&gt;,<br>C &lt;c@example.org&gt;</td></tr>")["issues"] == ["recipients"]
    assert head(f"<tr><td><b>A</b></td>{date}</tr><tr><td>Reply-To: x@example.com<br>to: S &lt;s@example.net&gt;</td></tr>")["issues"] == []
    assert head("<tr><td></td></tr>")["issues"] == ["sender", "date", "recipients"]
    assert headers.address_list(None) == ([], True) and headers.address_list("a@b.c; Kim 〈k@b.c〉; ,")[1] is True and headers.address_list("〈x〉") == ([], False)


REFUSED = [
    "https://evil.example/?view=att&th=THREAD_REAL&attid=0.1", "https://mail.google.com.evil.example/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1", "http://mail.google.com/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1",
    "/mail/u/1/?view=att&th=THREAD_REAL&attid=0.1", "/mail/u/0/?view=att&th=OTHER&attid=0.1", "/mail/u/0/other?view=att&th=THREAD_REAL&attid=0.1", "/mail/u/0/?view=att&th=THREAD_REAL", "/mail/u/0/?view=att&th=THREAD_REAL&permmsgid=msg-f:123",
    "/mail/u/0/?view=att&view=att&th=THREAD_REAL&attid=0.1", "/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1&attid=0.2", "/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1#fragment", "../1/?view=att&th=THREAD_REAL&attid=0.1",
    "other?view=att&th=THREAD_REAL&attid=0.1", "/?view=att&th=THREAD_REAL&attid=0.1", "//evil.example/?view=att&th=THREAD_REAL&attid=0.1", "https://user@mail.google.com/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1", "", None,
    "/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1&x=" + "a" * 4096,
]


def test_urls():
    link = "?view=att&th=THREAD_REAL&attid=0.1&disp=safe"
    for raw in (link, "/mail/u/0/" + link, HOME + "/mail/u/0/" + link, "https:\\\\mail.google.com\\mail\\u\\0\\" + link, HOME + ":443/mail/x/../u/0/" + link):
        assert urls.attachment_url(raw, THREAD, ACCOUNT) == f"{HOME}/mail/u/0/{link}", raw
    assert [r for r in REFUSED if urls.attachment_url(r, THREAD, ACCOUNT)] == []
    assert urls.attachment_url(link, "abc", ACCOUNT) is None and urls.attachment_url(link, THREAD, "x") is None
    key = urls.capability_key
    assert key("/mail/u/0/?view=att&th=T&attid=0.1&permmsgid=msg-f:9") == key("/mail/u/0/?ui=2&ik=abc&attid=0.1&permmsgid=msg-f:9&th=T") == "msg:msg-f:9:0.1"
    assert key("?attid=0.1&realattid=f_abc") == key("?attid=0.2&realattid=f_abc") and key("?view=att") is None and key("::::") is None
    accounts = {HOME + "/mail/u/12/#inbox": "12", HOME + "/mail/#inbox": "0", HOME + "/not-mail/u/0/": None, "https://evil.example/mail/u/0/": None, HOME + "/mail/b/team@example.com/#all/x": None}
    assert {u: urls.account_index(u) for u in accounts} == accounts
    safe = {"mailto:a@b": True, "https://ex.com": True, "http://u:p@ex.com": False, "https://": False, "ftp://ex.com": False, "/x": False, "https://b\u00fccher.example/": True, "https://ex ample.com": False, None: False}
    assert {u: urls.safe_link(u) for u in safe} == safe
    assert urls.interface_icon("https://ssl.gstatic.com/ui/v1/icons/mail/images/pdf.gif") and not urls.interface_icon("https://evil.example/icons/mail/x.gif") and not urls.interface_image("icons/mail/x.gif")
    assert urls.image_source("https://x.googleusercontent.com/proxy/A#https://a.b/c.png") == "https://a.b/c.png"


def test_titles():
    good = ["Gmail - {}", "{} - Gmail", "Gmail \u2014 {}", "{} - someone@example.com - Gmail", "{} - Acme Mail", "{} - Acme Corp Mail", "{}", "Re: {}"]
    assert all(subjects.title_matches(t.format("Q3 Budget Review"), "Q3 Budget Review") for t in good)
    assert subjects.title_matches("Gmail - Q3 - Final Draft", "Q3 - Final Draft") and subjects.title_matches("Gmail", "Gmail")
    bad = [("Gmail - Budget", "Budget Q3"), ("Gmail - Budget Q3", "Budget"), ("", "Budget"), ("Gmail - Budget", ""), (None, None), (" - ".join("abcdefghij"), "a")]
    assert not any(subjects.title_matches(*x) for x in bad)
    assert subjects.same("\uff31\uff13 Plan", "Fwd: Q3 plan!") and subjects.same("!!!", "Re: !!!") and not subjects.same("", "")


def attach(container=True, icon=True, name="Contract.pdf", href="/mail/u/0/?view=att&amp;th=THREAD_REAL&amp;attid=0.1"):
    image = '<td><img src="https://ssl.gstatic.com/ui/v1/icons/mail/images/pdf.gif"></td>' if icon else ""
    cell = f'<td><a href="{href}"><b>{name}</b></a> 153K</td>' if href else f"<td><b>{name}</b> 153K</td>"
    return f"<div>See attached.<table><tr>{image}{cell}</tr></table></div>"


def found(html):
    root = parse(html)
    return (*attachments.printed(root, THREAD, ACCOUNT), markdown(root))


def test_printed_attachments():
    items, issues, body = found(attach())
    assert [(x["name"], x["size"], x["url"]) for x in items] == [("Contract.pdf", "153K", HOME + "/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1")] and issues == [] and body == "See attached."
    items, issues, body = found(attach(href=None))
    assert items[0]["url"] is None and issues == ["no download link for Contract.pdf"] and body == "See attached."
    items, issues, _ = found(attach(href="https://evil.example/?view=att&amp;th=THREAD_REAL&amp;attid=1"))
    assert len(items) == 1 and issues == ["download link rejected by URL policy for Contract.pdf"]
    items, issues, body = found('<div>Keep <a href="https://evil.example/?view=att&amp;th=THREAD_REAL&amp;attid=1"><b>trap.txt</b></a></div>')
    assert items == [] and "trap.txt" in body
    items, issues, body = found('<div>T.<table><tr><td><img src="https://ssl.gstatic.com/ui/v1/icons/mail/images/pdf.gif"></td><td>mystery</td></tr></table></div>')
    assert items == [] and issues == ["attachment icon without a filename"] and "mystery" in body


def test_chips():
    url = HOME + "/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1"
    page = f"""<div download_url="application/pdf:Claim%20form.pdf:{url.replace("&", "&amp;")}"><span class="aV3">Claim form.pdf</span></div><div class="aQA"><span title="claim FORM.pdf"></span></div>
    <div class="aQA"><a href="https://youtube.example/v"><span title="A film"></span></a></div><div class="a3s"><span class="aV3">planted.pdf</span></div><span class="aV3">bare.txt</span>"""
    items, more = attachments.chips(parse(page), THREAD, ACCOUNT)
    assert [(x["name"], x["href"]) for x in items] == [("Claim form.pdf", url), ("bare.txt", None)] and not more
    assert attachments.chips(parse("".join(f'<span class="aV3">f{i}.txt</span>' for i in range(501))), THREAD, ACCOUNT)[1]
    assert attachments.download_parts("text/plain:a.txt:javascript:alert(1)") is None and attachments.download_parts("t:100%.txt:https://x")["name"] == "100%.txt"


def test_merging_and_names():
    link = lambda i, more="": f"/mail/u/0/?view=att&th=THREAD_REAL&attid=0.{i}{more}"
    printed = [{"name": "a.pdf", "url": HOME + link(1), "message_n": 1}, {"name": "b.pdf", "url": None, "message_n": 2}, {"name": "b.pdf", "url": None, "message_n": 3}]
    live = [{"name": "other", "href": link(1, "&disp=x")}, {"name": "B.PDF", "href": "https://evil.example/x"}, {"name": "b.pdf", "href": link(2), "size": "4K"}, {"name": "new.txt", "href": link(3)}]
    out, extra = attachments.merged(printed, live, THREAD, ACCOUNT)
    assert extra == 1 and [x.get("href") for x in out] == [None, "https://evil.example/x", HOME + link(2), link(3)] and out[2]["size"] == "4K"
    done = attachments.normalised(out, THREAD, ACCOUNT)
    assert [(x["target_name"], x["rejected_url"], x["message_n"]) for x in done] == [("a.pdf", False, 1), ("b.pdf", True, 2), ("b (2).pdf", False, 3), ("new.txt", False, None)]
    assert attachments.normalised(done, THREAD, ACCOUNT)[2]["url"] == done[2]["url"] and len(attachments.normalised(done + done, THREAD, ACCOUNT)) == 5
    names = attachments.Names()
    assert [names.take(n) for n in ("invoice.pdf", "invoice (2).pdf", "INVOICE.pdf", "\ufb01le", "file")] == ["invoice.pdf", "invoice (2).pdf", "INVOICE (3).pdf", "\ufb01le", "file (2)"]
    assert attachments.safe_name("../../etc/pass:wd..pdf") == "_._etc_pass_wd.pdf" and attachments.safe_name("CON.txt") == "_CON.txt" and attachments.safe_name(None) == "attachment"
    long = attachments.safe_name("x" * 200 + ".pdf")
    assert len(long) == 100 and long.endswith(".pdf") and attachments.safe_name("e\u0301.txt") == unicodedata.normalize("NFC", "e\u0301.txt")


def test_decoding():
    assert attachments.decoded(b"\xff\xfea\x00", None) == "a" and attachments.decoded(b"\xef\xbb\xbfa", "text/plain; charset=latin1") == "a"
    assert attachments.decoded(b"\xe9\x80", "text/plain; charset='ISO-8859-1'") == "\u00e9\u20ac" and attachments.decoded(b"\xff", "text/plain; charset=nope") == "\ufffd"


def page(*messages, title="Gmail - Offer"):
    return f"<html><head><title>{title}</title></head><body>" + "".join(f'<table class="message">{m}</table>' for m in messages) + "</body></html>"


def message(name, body, date="Sun, Jun 14, 2026 at 7:51 AM", to="to: Sam &lt;sam@example.net&gt;"):
    return f"<tr><td><b>{name}</b> {name.lower()}@example.com</td><td>{date}</td></tr><tr><td>{to}</td></tr><tr><td>{body}</td></tr>"


PAGES = [
    ("whole", page(message("Jen", "<div>Hi,</div><div>Rates below.</div>"), message("Sam", attach(name="notes.txt") + '<blockquote class="gmail_quote">old</blockquote>')), None),
    ("partial", page(message("Jen", "Hi"), "<tr><td>odd</td></tr>"), None),
    ("other", page(message("Jen", "Hi"), title="Gmail - Something else"), None),
    ("none", "<p>nothing</p>", None),
    ("live", "", '<div class="adn"><span class="gD" name="Jen" email="jen@example.com"></span><span class="g3" title="Jul 7, 2026, 4:03 PM"></span><div class="a3s"><p>Seen</p></div></div><span class="aV3">extra.pdf</span>'),
    ("missing", None, None),
]


@pytest.fixture(scope="module")
def captured(spark):
    rows = [(THREAD if k == "whole" else f"thread-{k}", "0", "Offer", "America/New_York", html, live, k) for k, html, live in PAGES]
    return spark.createDataFrame(rows, "thread_id string, account_index string, subject string, timezone string, html string, live_html string, kind string")


def test_parsed_captures(captured):
    got = {r.kind: r.thread for r in captures.parsed(captured).collect()}
    assert {k: t.status for k, t in got.items()} == {"whole": "ok", "partial": "ok", "other": "mismatch", "none": "empty", "live": "ok", "missing": "empty"}
    whole = got["whole"]
    assert [(m.n, m["from"].name, m.body) for m in whole.messages] == [(1, "Jen", "Hi,\nRates below."), (2, "Sam", "See attached.")]
    assert whole.quoted_trimmed and whole.messages_complete and whole.headers_complete and whole.attachments_complete and whole.warnings == []
    assert [(a.name, a.message_n, a.rejected_url) for a in whole.attachments] == [("notes.txt", 2, False)]
    part = got["partial"]
    assert (part.source, part.expected, part.messages_complete, part.headers_complete) == ("print-view-partial", 2, False, False) and part.warnings[0].code == "MESSAGE_SKIPPED"
    live = got["live"]
    assert (live.source, live.messages[0].body) == ("visible-page-partial", "Seen") and [w.code for w in live.warnings] == ["VISIBLE_PAGE_FALLBACK", "ATTACHMENT_ATTRIBUTION_UNKNOWN"]


def test_capture_run(spark, captured):
    url = HOME + "/mail/u/0/?view=att&th=THREAD_REAL&attid=0.1"
    files = spark.createDataFrame([(THREAD, url, "text/plain", bytearray(b"a]]>b\n"))], "thread_id string, url string, content_type string, content binary")
    out = capture.run(captured, files)
    docs = {r.thread_id: r.document for r in out.documents.collect()}
    assert set(docs) == {THREAD, "thread-partial", "thread-live"} and {r.thread_id for r in out.refused.collect()} == {"thread-other", "thread-none", "thread-missing"}
    lines = docs[THREAD].split("\n")
    assert lines[:5] == ['<email_thread format_version="3">', "<meta>", "<subject>Offer</subject>", "<messages>2</messages>", "<message_candidates>2</message_candidates>"]
    assert '<message n="1" date="2026-06-14T11:51:00.000Z" local="Sun, Jun 14, 2026 at 7:51 AM" from="Jen" email="jen@example.com">' in lines
    assert '<attachment name="notes.txt" type="text/plain" size="153K" status="inlined" inlined_bytes="6"><![CDATA[a]]]]><![CDATA[>b' in lines
    assert "<attachment_count>1</attachment_count>" in lines and '<completeness messages="true" headers="true" attachments="true"/>' in lines and "<complete>true</complete>" in lines
    assert '<warning code="QUOTED_TEXT_TRIMMED">Recognized quoted reply chains and signatures were removed.</warning>' in lines and f"<url>{HOME}/mail/u/0/#all/{THREAD}</url>" in lines
    assert lines[lines.index("<to>") + 1] == '<recipient name="Sam" email="sam@example.net"/>'
    assert '<attachments attribution="unknown">' in docs["thread-live"] and 'code="ATTACHMENT_UNAVAILABLE"' in docs["thread-live"]
    spark.createDataFrame([(d,) for d in docs.values()], "d string").select(F.xpath_int("d", F.lit("count(//message)"))).collect()
    said = {r.thread_id: r.summary for r in out.summaries.collect()}
    assert said[THREAD] == "\u2713 Copied 2 messages \u00b7 1 attachment \u00b7 1 inlined \u00b7 quoted text trimmed" and said["thread-live"].startswith("\u26a0 Copied 1 message")


def test_collected_budget_and_status(spark):
    fields = "thread_id string, ord int, subject string, name string, target_name string, declared_type string, size string, url string, rejected_url boolean, message_n int, source string"
    names = [("a.txt", "1K"), ("b.pdf", "30 MB"), ("c.txt", None), ("d.txt", None), ("e.txt", None), ("f.txt", None), ("g.txt", None), ("h.txt", None)]
    items = [("t", i, "S", n, n, None, size, f"u{i}" if n != "h.txt" else None, n == "h.txt", 1, "x") for i, (n, size) in enumerate(names)]
    sizes = {0: 10, 1: 50, 2: 200_000, 3: 102_400, 4: 90_000, 5: 20_000}  # g.txt can't be read
    files = spark.createDataFrame([("t", f"u{i}", "text/plain", bytearray(b"x" * n)) for i, n in sizes.items()], "thread_id string, url string, content_type string, content binary")
    got = {r.name: r for r in attachments.collected(spark.createDataFrame(items, fields), files).collect()}
    left, want = 300 << 10, {}
    for i, (n, _) in enumerate(names):
        if n.endswith(".txt") and i in sizes and left:
            want[n] = min(sizes[i], 100 << 10, left)
            left -= want[n]
    assert {n: r.inlined_bytes for n, r in got.items() if r.inlined_bytes is not None} == want
    assert got["c.txt"].status == "inlined (truncated)" and got["c.txt"].content.endswith("x\n[truncated after 100 KB of 195 KB]") and got["b.pdf"].status == "not downloaded (use Copy + save files)"
    assert got["g.txt"].status == "not inlined: thread text limit reached" or left and got["g.txt"].status == "could not be read"
    assert got["h.txt"].status == "unsafe download link rejected"
    results = spark.createDataFrame([("t", "u0", True, "gmail-threads/s/a.txt", None, None), ("t", "u2", False, None, None, "blocked")], "thread_id string, url string, ok boolean, path string, status string, error string")
    done = attachments.collected(spark.createDataFrame(items, fields), files, results)
    saved = {r.name: (r.status, r.path) for r in done.collect()}
    assert saved["a.txt"] == ("download started", "gmail-threads/s/a.txt") and saved["b.pdf"] == ("not downloaded: exceeds 25.0 MB limit", None) and saved["c.txt"] == ("blocked", None) and saved["d.txt"][0] == "download failed to start"
    c = attachments.counters(done).first()
    assert (c.total, c.download_started, c.skipped, c.unsafe, c.no_link, c.download_failed) == (8, 1, 1, 1, 0, 5)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_more_scalars(spark):
    lit = F.lit
    dates = {"Tue, 7 Jul 2026 16:03": "2026-07-07T16:03:00.000Z", "Mon, Jul 7, 2026 at 4:03\u202fPM": "2026-07-07T16:03:00.000Z", "Jul 7, 2026": "2026-07-07T00:00:00.000Z", "soon": None, "Jul 7, 1889 at 4:03 PM": None}
    rows = spark.createDataFrame([(k,) for k in dates], "d string").select("d", text.iso_time(F.col("d")).alias("iso")).collect()
    assert {r.d: r.iso for r in rows} == dates
    assert one(spark, text.clean_type(lit("image/x;y"), lit("a.PDF"))) == "application/pdf" and one(spark, text.clean_type(lit(" a/b "), lit("x"))) == "a/b" and one(spark, text.clean_type(lit(None).cast("string"), lit("x"))) is None
    assert one(spark, text.plain_address(lit('"Moe" <moe@x.com>'))) == "Moe (moe@x.com)" and one(spark, text.plain_address(lit("<moe@x.com>"))) == "moe@x.com"
    assert one(spark, policy.reported_path(lit("C:\\Users\\k\\gmail-threads\\q3\\a (1).pdf"), lit("gmail-threads/q3/a.pdf"))) == "gmail-threads/q3/a (1).pdf" and one(spark, policy.reported_path(lit(None).cast("string"), lit("p"))) == "p"
    paths = ["", "/gmail-threads/q3/i.pdf", "gmail-threads/../i.pdf", "other/q3/i.pdf", "gmail-threads/q3", "gmail-threads/q3/i\n.pdf", "gmail-threads/con/i.pdf", "gmail-threads/q3/CON .txt", "gmail-threads/q3/i."]
    assert not any(one(spark, policy.safe_path(lit(p))) for p in paths)
    assert one(spark, urls.print_view_url(lit("0"), lit("a b"), lit("k"))) == HOME + "/mail/u/0/?view=pt&search=all&th=a%20b&ik=k"
    assert tuple(one(spark, threads.recipient(lit("Moe (moe@x.com)")))) == ("Moe", "moe@x.com") and tuple(one(spark, threads.recipient(lit("Moe (x)")))) == ("Moe (x)", "")
    assert one(spark, captures.login_page(lit(None).cast("string"), lit("<title>Please Sign In</title>"))) and not one(spark, captures.login_page(lit("https://x"), lit("<title>Mail</title>")))
    assert one(spark, threads.warning_tag(F.struct(lit(None).cast("string").alias("code"), lit("a<b").alias("message")))) == '<warning code="CAPTURE_WARNING">a&lt;b</warning>'
    assert one(spark, outcomes.size_notice(lit(500 << 10))) == "500 KB" and one(spark, outcomes.size_notice(lit(3 << 20))) == "3.0 MB"
    assert not one(spark, captures.same_identity(lit("t"), lit(None).cast("string"), lit("S"), lit("t"), lit("0"), lit("S")))


def test_distinct_warnings(spark):
    rows = spark.createDataFrame([("t", 0, "A", "x"), ("t", 1, "A", "x"), ("t", 2, "A", "y"), ("u", 0, "A", "x")], "thread_id string, ord int, code string, message string")
    assert sorted((r.thread_id, r.ord) for r in outcomes.distinct_warnings(rows).collect()) == [("t", 0), ("t", 2), ("u", 0)]


def test_redaction(spark):
    html = """<html><head><title>Gmail - Secret Client Thread</title><script>x()</script></head><body onload="x()"><!-- Secret --><img src="http://127.0.0.1/leak" alt="Secret Client"><a href="/private/path?token=Secret">Secret Link</a>
    <table class="message"><tr><td><b>Secret Sender</b> sender@private.example</td><td>Jul 7, 2026</td></tr><tr><td>to: R &lt;r@private.example&gt;</td></tr><tr><td><div>Call +1 415 555 0137, SSN 123-45-6789, account 000123456789, at 4:03.</div>
    <div>\u4f60\u597d\uff0c\u8fd9\u662f\u673a\u5bc6</div><a href="/mail/u/7/?view=att&amp;th=SECRET&amp;attid=secret-id"><b>private-plan.pdf</b></a><div download_url="text/plain:secret.txt:https://mail.google.com/mail/u/7/?attid=s" aria-label="Secret" id="x" data-a="Secret"></div></td></tr></table></body></html>"""
    got = redact.redact(html)
    page = got["html"]
    for leak in ("secret", "private.example", "127.0.0.1", "/private/path", "415 555 0137", "123-45-6789", "000123456789", "\u673a\u5bc6", "onload", "<script", "data-a"):
        assert leak not in page.lower(), leak
    assert got["safe"] and (got["message_count"], got["people"], got["files"]) == (1, 2, 2) and "4:03" in page and "Jul" in page and "document-1.pdf" in page
    assert 'href="/mail/u/0/?view=att&amp;th=THREAD_REAL&amp;attid=redacted-1&amp;disp=safe"' in page and 'download_url="text/plain:document-2.txt:/mail/u/0/' in page
    rows = spark.createDataFrame([(html,), (None,)], "html string").select(redact.redacted(F.col("html")).alias("r"))
    kept = rows.select(redact.verified(F.col("r.html")).alias("page"), redact.sidecar(F.col("r")).alias("s")).collect()
    assert kept[0].page == page and kept[0].s.schema_version == 1 and kept[0].s.expected_complete is None
    with pytest.raises(Exception, match="safety check"):
        spark.range(1).select(redact.verified(F.lit("<a href='javascript:x'>"))).collect()


def test_redaction_of_long_texts():
    """Places are counted once: a text of 100,000 words takes a second, and stand-ins depend on places in UTF-16 units."""
    began = time.process_time()
    shown = redact.Redactor().text("abc \U0001f600 12345 " * 50000)
    assert time.process_time() - began < 20
    words = shown.split(" ")
    stand_in = [redact.WORDS[(3 * 7 + 13 * k) % len(redact.WORDS)] for k in range(1000)]
    assert words[0:3000:3] == stand_in
