"""Classification of generator responses kept in a log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx

# fixed values: event columns, refusal wording, output cap
EVENTS = ("array<struct<type:string,subtype:string,is_error:boolean,result:string,terminal_reason:string>>")
REFUSAL = r"(?i)\A(?:policy refusal:|api error:[\t\n\f\r ]*(?:refused\b|safeguards flagged\b|fable 5(?:'s|’s) safeguards flagged\b))"
MAX_STDOUT = 4 << 20


def last_result(stdout: Column) -> Column:
    """The last ``result`` event, or null."""
    events = F.from_json(stdout, EVENTS)
    return F.try_element_at(F.filter(events, lambda e: e["type"] == "result"), F.lit(-1))


def classify_responses(log: DataFrame, max_stdout: int = MAX_STDOUT) -> DataFrame:
    """Add ``error_class`` (null for success), ``message`` and ``page_content``.

    ``log`` has ``stdout, stderr, exit_code, timed_out`` and ``cancelled``.
    Refusal wins over all but a cancelled call.
    """
    stdout = F.col("stdout")
    first = F.left(tx.trim_space(stdout), F.lit(1))
    shaped = first.isin("{", "[")
    events = F.when(shaped, F.from_json(stdout, EVENTS))
    # a row that is not an array of events parses to null
    final = F.try_element_at(F.filter(events, lambda e: e["type"] == "result"), F.lit(-1))
    rows = log.withColumn("_final", final).withColumn("_read", F.coalesce(events.isNotNull() & (first == "["), F.lit(False)))
    plain = F.when(shaped, F.lit("")).otherwise(stdout)

    final = F.col("_final")
    is_error = F.coalesce(final["is_error"], F.lit(False))
    subtype, reason = F.coalesce(final["subtype"], F.lit("")), F.coalesce(final["terminal_reason"], F.lit(""))
    body = F.coalesce(final["result"], F.lit(""))
    eligible = final.isNotNull() & ((reason == "api_error") | (is_error & (subtype == "error_during_execution")))
    diagnostic = final.isNotNull() & is_error & ((reason == "api_error") | (subtype == "error_during_execution"))
    # normalised once each; behind a generator, so that every later use reads the column
    texts = F.struct(*[F.coalesce(tx.normalize_diagnostic(c), F.lit("")).alias(n) for n, c in (("body", body), ("stderr", F.col("stderr")), ("plain", plain))])
    rows = rows.withColumn("_told", F.explode(F.array(texts)))
    says = {n: F.col("_told")[n] for n in ("body", "stderr", "plain")}
    refused = (eligible & says["body"].rlike(REFUSAL)) | says["stderr"].rlike(REFUSAL) | says["plain"].rlike(REFUSAL)
    event_error = final.isNotNull() & (is_error | (subtype == "error_during_execution") | (reason == "api_error"))
    page = tx.strip_fence(body)

    told = F.coalesce(
        F.when(diagnostic & tx.diagnostic_shaped(body), says["body"]),
        F.nullif(says["stderr"], F.lit("")), F.nullif(says["plain"], F.lit("")))

    steps = [
        (F.col("cancelled"), "transient", F.lit("context cancelled")),
        (refused, "refused", F.lit("policy refusal")),
        (F.octet_length(stdout) > max_stdout, "permanent", F.lit(f"stdout exceeded {max_stdout} bytes")),
        (F.col("timed_out"), "transient", F.lit("timeout")),
        (F.col("exit_code") != 0, "transient", F.coalesce(told, F.concat(F.lit("exit status "), F.col("exit_code")))),
        (event_error, "transient", F.coalesce(told, F.lit("execution error"))),
        (~F.col("_read"), "permanent", F.lit("parse output")),
        (final.isNull(), "permanent", F.lit("no result event")),
        (subtype != "success", "permanent", F.concat(F.lit("unexpected result subtype "), subtype)),
        (page == "", "permanent", F.lit("empty result")),
    ]
    step = F.lit(len(steps))
    for i, (test, _, _) in reversed(list(enumerate(steps))):
        step = F.when(test, i).otherwise(step)
    rows = rows.withColumn("_step", F.explode(F.array(step)))
    kinds = F.array(*[F.lit(name) for _, name, _ in steps])
    message = F.lit(None).cast("string")
    for i, (_, _, text) in enumerate(steps):
        message = F.when(F.col("_step") == i, text).otherwise(message)
    return rows.withColumn("error_class", F.get(kinds, F.col("_step"))).withColumn("message", message).withColumn(
        "page_content", F.when(F.col("error_class").isNull(), page)).drop("_final", "_read", "_told", "_step")
