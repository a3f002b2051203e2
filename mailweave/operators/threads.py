"""Participants, attachments and envelopes of threads.

Inputs carry their order in columns; results depend on these alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from mailweave.functions import xml
from mailweave.operators.attachments import Names, budgeted


def participants(people: DataFrame) -> DataFrame:
    """(thread_id, ord, name, email): one row per address by first sight, with the first display name found.

    people: thread_id, ord, name, email.
    """
    key = F.lower(F.when(F.col("email") != "", F.col("email")).otherwise(F.col("name")))
    named = (F.col("name") != "") & (F.col("name") != F.col("email"))
    who = F.struct("name", "email")
    found = people.withColumn("key", key).where("key <> ''").groupBy("thread_id", "key")
    out = found.agg(F.min("ord").alias("ord"), F.coalesce(F.min_by(F.when(named, who), F.when(named, F.col("ord"))), F.min_by(who, "ord")).alias("p"))
    return out.select("thread_id", "ord", "p.name", "p.email")


def first_attachments(items: DataFrame) -> DataFrame:
    """One row per thread and URL, the first; message and size come from the first row that has them. No URL, no merging."""
    same = Window.partitionBy("thread_id", F.coalesce(F.col("url"), F.concat(F.lit("#"), F.col("ord").cast("string")))).orderBy("ord")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = items.withColumn("message_n", F.first("message_n", True).over(whole)).withColumn("size", F.first(F.when(F.col("size") != "", F.col("size")), True).over(whole))
    return out.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


def inline_budget(items: DataFrame, thread: str, order: str, size: str, eligible: Column | None = None) -> DataFrame:
    """Adds inlined_bytes and truncated: eligible files in order share a budget per thread and have one each; others get nothing."""
    out = budgeted(items, thread, order, size, eligible)
    given = F.coalesce("inlined_bytes", F.lit(0)).cast("long")
    return out.withColumn("inlined_bytes", given).withColumn("truncated", F.coalesce(given < F.col(size), F.lit(False))).drop("budget_left")


def distinct_names(items: DataFrame, thread: str, order: str, name: str) -> DataFrame:
    """Adds target_name: a name taken before in its thread (in any case) gets the least free " (k)", k from 2.

    A thread's names are settled in one fold over their array, so only names meet; rows are joined back by their order.
    """
    settle = F.pandas_udf(lambda s: s.map(lambda names: _settled(names)), ArrayType(StringType()))
    listed = items.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct(order, name))).alias("rows"))
    named = listed.select(thread, "rows", settle(F.transform("rows", lambda r: r[name])).alias("targets"))
    each = named.select(thread, F.explode(F.arrays_zip("rows", "targets")).alias("x")).select(thread, F.col(f"x.rows.{order}").alias(order), F.col("x.targets").alias("target_name"))
    return items.join(each, [thread, order])


def _settled(names: Iterable[str]) -> list[str]:
    known = Names()
    return [known.take(n) for n in names]


def recipient(c: Column) -> Column:
    """A recipient written as text: ``Name (address)``, else a name alone."""
    raw, form = F.trim(F.coalesce(c, F.lit(""))), r"\A(.*?)\s*\(([^()@\s]+@[^()\s]+)\)\z"
    split = raw.rlike(form)
    name = F.when(split, F.trim(F.regexp_extract(raw, form, 1))).otherwise(raw)
    return F.struct(name.alias("name"), F.when(split, F.regexp_extract(raw, form, 2)).otherwise("").alias("email"))


def recipients(tag: str, column: str) -> Column:
    """<tag> with a line for each recipient; null if there is none."""
    lines = F.array_join(F.transform(column, lambda p: xml.tag("recipient", xml.attribute("name", p["name"]), xml.attribute("email", p["email"]))), "\n")
    return F.when(F.size(column) > 0, F.concat(F.lit(f"<{tag}>\n"), lines, F.lit(f"\n</{tag}>")))


def attachment_tag(a: Column) -> Column:
    """One attachment with its status, and its text if it has been inlined."""
    count = F.when(a["inlined_bytes"].isNotNull(), F.concat(F.lit('inlined_bytes="'), a["inlined_bytes"].cast("string"), F.lit('"')))
    name = F.when(F.coalesce(a["name"], F.lit("")) != "", a["name"]).otherwise("attachment")
    told = [xml.attribute(k, a[k]) for k in ("type", "size", "path", "status", "inline_status")]
    head = F.concat_ws(" ", F.lit("<attachment"), xml.attribute("name", name), *told, count, F.when(a["truncated"], 'truncated="true"'))
    return F.when(a["content"].isNull(), F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), xml.cdata(a["content"]), F.lit("</attachment>")))


def warning_tag(w: Column) -> Column:
    code = F.when(F.coalesce(w["code"], F.lit("")) != "", w["code"]).otherwise("CAPTURE_WARNING")
    said = F.when(F.coalesce(w["message"], F.lit("")) != "", w["message"]).otherwise(code)
    return F.concat(F.lit('<warning code="'), xml.quoted(code), F.lit('">'), xml.escaped(said), F.lit("</warning>"))


def message_block(n: Column, date: Column, local: Column, name: Column, email: Column, body: Column, before: list[Column] | None = None, after: list[Column] | None = None) -> Column:
    shown = F.coalesce(F.when(name != "", name), F.when(email != "", email), F.lit("unknown"))
    head = F.concat(F.concat_ws(" ", F.concat(F.lit('<message n="'), n.cast("string"), F.lit('"')), xml.attribute("date", date), xml.attribute("local", local), xml.attribute("from", shown), xml.attribute("email", email)), F.lit(">"))
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    text = F.when(text == "", "[no text content]").otherwise(text)
    return F.concat_ws("\n", head, *(before or []), F.concat(F.lit('<body format="markdown">'), xml.cdata(text), F.lit("</body>")), *(after or []), F.lit("</message>"))


def _lines(tag: str, column: str, given: str = "") -> Column:
    """<tag> around the lines of an array column; null if it is null or empty."""
    return F.when(F.size(column) > 0, F.concat(F.lit(f"<{tag}{given}>\n"), F.array_join(column, "\n"), F.lit(f"\n</{tag}>")))


def _own(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def documents(threads: DataFrame, messages: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """(thread_id, document): the envelope of every thread.

    threads: thread_id, subject, source, and if known messages_complete, headers_complete, attachments_complete (null
    counts as false), expected, timezone, url, quoted_trimmed, warnings(code, message). messages: thread_id, n, name, email,
    date, local, body, and if known to, cc, bcc. attachments: as ``attachments.collected`` gives them. A thread's messages
    meet in one row, as its document is one value.
    """
    person = "array<struct<name: string, email: string>>"
    said = messages.select("thread_id", "n", "name", "email", "date", "local", "body", *(_own(messages, c, person).alias(c) for c in ("to", "cc", "bcc")))
    own = F.transform(F.array(F.struct("name", "email")), lambda p: F.struct(p["name"].cast("string").alias("name"), p["email"].cast("string").alias("email")))
    everyone = F.concat(own, *(F.coalesce(c, F.expr(f"cast(array() as {person})")) for c in ("to", "cc", "bcc")))
    people = participants(said.select("thread_id", "n", F.posexplode(everyone).alias("k", "p")).select("thread_id", F.struct("n", "k").alias("ord"), "p.name", "p.email"))
    sign = xml.tag("participant", xml.attribute("name", F.col("name")), xml.attribute("email", F.col("email")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"])
    who = people.groupBy("thread_id").agg(ordered(F.struct("ord", sign.alias("line"))).alias("people"))
    after = []
    if attachments is not None:
        fields = ["name", "type", "size", "path", "status", "inline_status", "inlined_bytes", "truncated", "content"]
        line = attachment_tag(F.struct(*fields))
        held = attachments.select("thread_id", F.when(F.col("message_n") > 0, F.col("message_n")).alias("n"), F.struct("ord", line.alias("line")).alias("a"), F.col("path").isNotNull().alias("saved"))
        by_message = held.where("n IS NOT NULL").groupBy("thread_id", "n").agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["line"]).alias("files"))
        said = said.join(by_message, ["thread_id", "n"], "left")
        after = [_lines("attachments", "files")]
        loose = F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("a")))), lambda x: x["line"])
        by_thread = held.groupBy("thread_id").agg(F.count("*").alias("file_count"), F.bool_or("saved").alias("saved"), loose.alias("loose"))
    block = message_block(F.col("n"), F.col("date"), F.col("local"), F.col("name"), F.col("email"), F.col("body"), [recipients(c, c) for c in ("to", "cc", "bcc")], after)
    dated = F.when(F.col("date") != "", F.col("date"))
    spoken = said.groupBy("thread_id").agg(F.count("*").alias("count"), F.min(dated).alias("d0"), F.max(dated).alias("d1"), F.count(dated).alias("dated"), ordered(F.struct("n", block.alias("line"))).alias("blocks"))
    kinds = {"expected": "int", "timezone": "string", "url": "string", "quoted_trimmed": "boolean", "warnings": "array<struct<code: string, message: string>>"}
    flags = ["messages_complete", "headers_complete", "attachments_complete"]
    whole = threads.select("thread_id", "subject", "source", *(F.coalesce(_own(threads, c, "boolean"), F.lit(False)).alias(c) for c in flags), *(_own(threads, c, k).alias(c) for c, k in kinds.items()))
    whole = whole.join(spoken, "thread_id", "left").join(who, "thread_id", "left")
    if attachments is not None:
        whole = whole.join(by_thread, "thread_id", "left")
    line = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    given = lambda tag, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", line(tag, xml.escaped(F.col(c))))
    filled = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)
    complete = F.col(flags[0]) & F.col(flags[1]) & F.col(flags[2])
    told = F.array_join(F.transform("warnings", warning_tag), "\n")
    some = F.size(F.coalesce("warnings", F.expr("cast(array() as array<struct<code: string, message: string>>)"))) > 0
    files = attachments is not None
    doc = F.concat_ws(
        "\n", F.lit('<email_thread format_version="3">\n<meta>'), line("subject", xml.escaped(filled("subject", "(no subject)"))), line("messages", F.coalesce("count", F.lit(0)).cast("string")),
        F.when(F.col("expected") >= 0, line("message_candidates", F.col("expected").cast("string"))), _lines("participants", "people"), F.when(F.col("dated") > 1, line("date_range", F.concat(xml.escaped(F.col("d0")), F.lit(" to "), xml.escaped(F.col("d1"))))),
        *([F.when(F.col("file_count") > 0, line("attachment_count", F.col("file_count").cast("string")))] if files else []), line("source", xml.escaped(filled("source", "unknown"))), given("capture_timezone", "timezone"),
        F.lit("<content_trust>untrusted_email_and_attachment_text</content_trust>"), F.concat(F.lit("<completeness"), *(F.concat(F.lit(f' {c.split("_")[0]}="'), F.col(c).cast("string"), F.lit('"')) for c in flags), F.lit("/>")), line("complete", complete.cast("string")), given("url", "url"),
        *([F.when(F.col("saved"), "<download_path_base>Chrome download directory</download_path_base>")] if files else []), F.when(some, told),
        F.when(~some & ~complete, '<warning code="PARTIAL_CAPTURE">Some messages, headers, or attachments could not be verified.</warning>'),
        F.when(F.col("quoted_trimmed"), '<warning code="QUOTED_TEXT_TRIMMED">Recognized quoted reply chains and signatures were removed.</warning>'), F.lit("</meta>"),
        *([_lines("attachments", "loose", ' attribution="unknown"')] if files else []), F.when(F.size("blocks") > 0, F.array_join("blocks", "\n")), F.lit("</email_thread>"),
    )
    return whole.select("thread_id", doc.alias("document"))
