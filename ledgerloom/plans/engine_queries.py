"""Queries that run the engine as a whole over rendered statements (see
``statements``); their SQL says what the ledger holds, and never sees a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, scan, text
from ledgerloom.operators import evaluation, geometry, listing, recognised, reconcile, requests, rows
from ledgerloom.plans import statements
from ledgerloom.plans.catalog import F0, F2, KEYS, ORACLES, QUERIES, C, L, P, T, query  # noqa: F401
from ledgerloom.plans.extract import extract, extract_lines, heads, held, lines_of, pages_of, upright
from ledgerloom.plans.ledger import ledger, parsed, printed, table
from ledgerloom.sources import results as sinks
from ledgerloom.sources import words as edges
from ledgerloom.sources.shared import place, written
from ledgerloom.streaming import documents

_RUNS: dict = {}


def _run(spark: SparkSession, sf: str) -> dict:
    """Words and lines, written once a session and state of the events' files (a file that
    is written again has another time), and what was made of them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf}/events.parquet").select("path", "modificationTime", "length")
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf, found.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*found.columns).cast("decimal(38,0)"))).first())
    if key not in _RUNS:
        _RUNS.clear()
        words = held(statements.render(spark, sf))
        _RUNS[key] = {"words": words, "lines": lines_of(upright(words))}
    return _RUNS[key]


def extracted(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The extraction's written tables."""
    run = _run(spark, sf)
    if "found" not in run:
        run["found"] = extract_lines(run["lines"], run["words"])
    return run["found"]


# The ledger as the statements show it, row by row (x), and what a reader finds (t).
X = f"""x0 as (
  select *, cast(ts as date) as day, (cast(ts as date) > date '2024-01-14')::int as half, ['two_columns', 'signed', 'sections', 'balance_delta'][(account % 4 + 1)::int] as kind,
         case side when 'deposit' then cents else -cents end as signed from l where cents <> 0),
x1 as (
  select *, (least(weekofyear(ts), 4) + half)::int as page, {statements.OPENING} + coalesce((select sum(signed) from x0 b where b.account = x0.account and b.half < x0.half), 0)::bigint as opening from x0),
x2 as (
  select *, case when kind = 'sections' then side end as part, row_number() over (partition by account, half order by page, case when kind = 'sections' then side end, ts, event_id) as nth,
         count(*) over (partition by account, half) as n_rows from x1),
x as (
  select *, account % 11 = 6 and account % 5 <> 4 and half = 1 and nth = n_rows as lost, kind <> 'sections' and event_id % 37 = 5 as no_amount,
         kind <> 'sections' and event_id % 41 = 7 and event_id % 37 <> 5 as no_date, event_id % 29 = 3 as wraps,
         kind = 'sections' and side = 'withdrawal' and event_id % 3 = 0 and account % 8 = 2 as only_listed,
         kind = 'sections' and side = 'withdrawal' and event_id % 3 = 0 and account % 8 = 6 as also_listed,
         case half when 0 then date '2024-01-01' else date '2024-01-15' end as starts, case half when 0 then date '2024-01-14' else date '2024-01-31' end as ends from x2),
t as (
  select account::varchar as doc_id, half as period, page, event_id, side, cents, no_amount as recovered, no_date as date_inherited,
         case when only_listed then 'C' || event_id when wraps then 'PAYMENT E' || event_id || ' REF E' || event_id else 'PAYMENT E' || event_id end as description,
         case when no_date then coalesce(last_value(case when not no_date and not no_amount then day end ignore nulls) over (partition by account, half order by nth rows between unbounded preceding and 1 preceding), starts) else day end as date
  from x where not lost),
h as (
  select account::varchar as doc_id, half as period, any_value(kind) as kind, any_value(opening) as beginning, any_value(opening) + sum(signed)::bigint as ending,
         coalesce(sum(cents) filter (side = 'deposit'), 0)::bigint as deposits_total, coalesce(sum(cents) filter (side = 'withdrawal'), 0)::bigint as withdrawals_total,
         case when account % 5 <> 4 then count(*) filter (side = 'deposit') end as deposits_count, case when account % 5 <> 4 then count(*) filter (side = 'withdrawal') end as withdrawals_count,
         any_value(starts) as starts, any_value(ends) as ends, account, bool_or(lost) as lost, max(cents) filter (lost) as lost_cents, max(side) filter (lost) as lost_side,
         count(*) filter (no_amount and not lost) as n_recovered, count(*) filter (no_date and not lost) as n_inherited, count(*) filter (only_listed and not lost) as n_listed, count(*) filter (also_listed and not lost) as n_left
  from x group by account, half)"""
STATED = f"with {L}, {X}"


@query(f"{STATED} select doc_id, period, page, side, cents, date, description, recovered, date_inherited from t")
def extract_transactions(spark, sf):
    """Rows: bands, sides of all four strategies, touching boxes, wrapped
    descriptions, amounts from the balance, dates of the row before, listings."""
    return extracted(spark, sf)["transactions"].select("doc_id", "period", "page", "side", "cents", "date", "description", "recovered", "date_inherited")


@query(f"""{STATED} select doc_id, period, case when lost then case lost_side when 'deposit' then -lost_cents else lost_cents end else 0 end::bigint as residual,
  not lost as reconciled, case when lost then 'dropped_row' end as diagnosis, case when lost then lost_side end as diag_side, case when lost then lost_cents end::double as diag_amount,
  case when lost then 'a ' || lost_side || ' of ' || (lost_cents // 100) || '.' || lpad((lost_cents % 100)::varchar, 2, '0') || ' was not read' end as detail,
  case when deposits_count is null then 4 when lost then 3 else 6 end as n_ok, 'deterministic' as path from h""")
def extract_checks(spark, sf):
    """Tie-out and diagnosis of what was read."""
    return extracted(spark, sf)["checks"].select("doc_id", "period", "residual", "reconciled", "diagnosis", "diag_side", "diag_amount", "detail", "n_ok", "path")


@query(f"""{STATED} select doc_id, period, ['HARBOUR BANK', 'Union Trust', 'First Mutual Savings'][(account % 3 + 1)::int] as bank, lpad((account % 10000)::varchar, 4, '0') as last4, starts as "start", ends as "end",
  beginning, ending, deposits_total, withdrawals_total, deposits_count, withdrawals_count from h""")
def extract_header(spark, sf):
    """Letterhead, account, cycle, and the summary in lines or as a block."""
    run = _run(spark, sf)
    if "found" not in run and "heads" not in run:
        run["heads"] = written(heads(run["lines"]), "heads")
    found = run["found"]["checks"] if "found" in run else run["heads"]
    return found.select("doc_id", "period", "bank", "last4", "start", "end", "beginning", "ending", "deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count")


@query(f"""{STATED}, w as (
  select doc_id, sum((account % 6 = 1 and period = 0)::int + (n_listed > 0)::int + (n_left > 0)::int) + max((account % 9 = 8)::int) as file_doubts from h group by doc_id)
select doc_id, period, n_recovered + n_inherited + file_doubts as n_doubts, deposits_count is not null as bounded, case when lost then 'extraction_uncertainty' else 'none' end as attribution,
  case when lost then 'exceptions_identified' when deposits_count is not null and n_recovered + n_inherited + file_doubts = 0 then 'tied' else 'tied_with_notes' end as verdict from h join w using (doc_id)""")
def extract_audit(spark, sf):
    """Doubts, attribution and verdict of what was read."""
    return extracted(spark, sf)["checks"].select("doc_id", "period", "n_doubts", "bounded", "attribution", "verdict")


@query(f"""{STATED}, c as (select * from h)
select doc_id, period, 'amount_from_balance' as warning, n_recovered::bigint as n from c where n_recovered > 0
union all select doc_id, period, 'date_from_row_before', n_inherited from c where n_inherited > 0
union all select doc_id, period, 'summary_table', 1 from c where account % 6 = 1 and period = 0
union all select doc_id, period, 'listing_added', n_listed from c where n_listed > 0
union all select doc_id, period, 'listing_left_out', n_left from c where n_left > 0
union all select doc_id, 0, 'no_text_layer', (select count(distinct page) from x where x.account = c.account) from c where account % 9 = 8 and period = 0""")
def extract_warnings(spark, sf):
    return extracted(spark, sf)["warnings"]


@query(f"""{STATED} select doc_id, period, kind as strategy, case when kind = 'two_columns' then 2 else 1 end as n_amounts, kind <> 'sections' as has_balance,
  ['M/d/yyyy', 'M/d', 'MMM d'][(account % 3 + 1)::int] as notation from h""")
def extract_layouts(spark, sf):
    """The layout that stays for each period."""
    found = extracted(spark, sf)
    best = found["checks"].select("doc_id", "period", "candidate").join(found["layouts"], ["doc_id", "period", "candidate"])
    return best.select("doc_id", "period", "strategy", F.size("amount_columns").alias("n_amounts"), F.col("balance_column").isNotNull().alias("has_balance"), F.col("date_formats")[0].alias("notation"))


@query(f"{STATED} select distinct account::varchar as doc_id, page, half as period from x")
def extract_periods(spark, sf):
    run = _run(spark, sf)
    if "found" not in run and "pages" not in run:
        run["pages"] = pages_of(run["lines"])
    found = run["found"]["periods"] if "found" in run else run["pages"]
    return found.select("doc_id", "page", "period")


@query(f"""{STATED}, o as (select doc_id, sum(case when lost then 1 else 0 end) as gone, count(*) as periods from h group by doc_id)
select doc_id, case when gone > 0 then 'fail' else 'pass' end as status, 5 * periods - gone as matched, 5 * periods as total from o""")
def extract_evaluation(spark, sf):
    """Printed figures and numbers of rows against the ledger's."""
    found = extracted(spark, sf)["checks"]
    seen = found.select("doc_id", "period", "reconciled", "beginning", "ending", "deposits_total", "withdrawals_total", (F.col("dep_n") + F.col("wd_n")).alias("transactions"))
    full = statements.facts(spark, sf).groupBy(F.col("account").cast("string").alias("doc_id"), F.col("half").alias("period"))
    sums = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("cents"))), F.lit(0))
    truth = full.agg(F.min("opening").alias("beginning"), (F.min("opening") + F.sum("signed")).alias("ending"), sums("deposit").alias("deposits_total"), sums("withdrawal").alias("withdrawals_total"), F.count(F.lit(1)).alias("transactions"))
    found = extracted(spark, sf)
    broken = evaluation.invariants(found["transactions"], found["checks"], found["files"], ["doc_id"], ["period"])
    return evaluation.report(truth, seen, ["doc_id"], ["period"], ["beginning", "ending", "deposits_total", "withdrawals_total", "transactions"], broken)


@query(f"""{STATED} select doc_id, case when bool_and(not lost) then 0 else 1 end as exit_code, sum(case when lost then case lost_side when 'deposit' then -lost_cents else lost_cents end else 0 end)::bigint as residual from h group by doc_id""")
def extract_exit_codes(spark, sf):
    return extracted(spark, sf)["checks"].groupBy("doc_id").agg(edges.exit_code(None), F.sum("residual").alias("residual"))


@query(f"""{STATED} select doc_id, period, doc_id || '/' || period || ' ' || case when deposits_count is null then '++++??' when not lost then '++++++' when lost_side = 'deposit' then '+--+-+' else '+-+-+-' end || ' ' ||
  case when lost and lost_side = 'deposit' then '-' else '' end || (coalesce(lost_cents, 0) // 100) || '.' || lpad((coalesce(lost_cents, 0) % 100)::varchar, 2, '0') as line from h""")
def extract_report(spark, sf):
    return edges.report_lines(extracted(spark, sf)["checks"], ["doc_id", "period"])


@query(f"""{STATED}, w as (
  select doc_id, 'confirm_no_transactions' as action from h where account % 6 = 1 and period = 0
  union all select doc_id, 'vouch_to_listing' from h where n_listed > 0 union all select doc_id, 'confirm_repeats_table' from h where n_left > 0
  union all select doc_id, 'descriptions_recognised' from h where account % 9 = 8 group by doc_id)
select doc_id, period, case lost_side when 'deposit' then -lost_cents else lost_cents end::bigint as amount, null::int as page, 'inspect_page' as action, 1 as position,
  'Residual ' || case lost_side when 'deposit' then '-' else '' end || (lost_cents // 100) || '.' || lpad((lost_cents % 100)::varchar, 2, '0') || ': a ' || lost_side || ' of ' || (lost_cents // 100) || '.' || lpad((lost_cents % 100)::varchar, 2, '0') || ' was not read' as description from h where lost
union all select doc_id, period, cents, page, 'vouch_amount', null, 'amount_from_balance' from t where recovered
union all select doc_id, period, cents, page, 'confirm_date', null, 'date_from_row_before' from t where date_inherited
union all select doc_id, period, null, null, action, null, case action when 'confirm_no_transactions' then 'summary_table' when 'vouch_to_listing' then 'listing_added' when 'confirm_repeats_table' then 'listing_left_out' else 'no_text_layer' end from h join w using (doc_id)""")
def extract_exceptions(spark, sf):
    """What a reviewer is to look at: a period's residual first, then what is in doubt."""
    found = extracted(spark, sf)["exceptions"]
    return found.select("doc_id", "period", "amount", "page", "action", F.when(F.col("description").startswith("Residual"), F.col("position")).alias("position"), "description")


@query(f"""{STATED} select doc_id, count(*) as n_periods, sum(n)::bigint as n_rows, bool_and(not lost) as reconciled, sum(s)::bigint as net
from h join (select doc_id, period, count(*) as n, sum(case side when 'deposit' then cents else -cents end) as s from t group by all) using (doc_id, period) group by doc_id""")
def extract_json(spark, sf):
    """The nested objects as they were written, read back."""
    path = place(spark, "json")
    sinks.write_results(extracted(spark, sf), path)
    shape = "doc_id string, reconciled boolean, periods array<struct<period: int, transactions: array<struct<side: string, cents: bigint>>>>"
    rows_ = F.flatten(F.transform("periods", lambda p: p["transactions"]))
    net = F.aggregate(rows_, F.lit(0).cast("bigint"), lambda n, r: n + F.when(r["side"] == "deposit", r["cents"]).otherwise(-r["cents"]))
    return spark.read.schema(shape).json(path).select("doc_id", F.size("periods").cast("bigint").alias("n_periods"), F.size(rows_).cast("bigint").alias("n_rows"), "reconciled", net.alias("net"))


@query(f"""{STATED}, c as (
  select *, case when deposits_count is null then '++++??' when not lost then '++++++' when lost_side = 'deposit' then '+--+-+' else '+-+-+-' end as marks,
    (coalesce(lost_cents, 0) // 100) || '.' || lpad((coalesce(lost_cents, 0) % 100)::varchar, 2, '0') as gone from h),
b as (
  select *, 'period ' || (period + 1) || case when lost then ': DID NOT RECONCILE' else ': reconciled' end || list_aggregate(list_transform(range(1, 7), lambda i:
      chr(10) || '    ' || lpad(case marks[i] when '+' then 'ok' when '-' then 'FAIL' else '--' end, 4, ' ') || '  ' ||
      ['printed_block_closes', 'balance_equation', 'deposits_total', 'withdrawals_total', 'deposits_count', 'withdrawals_count'][i]), 'string_agg', '') ||
    case when lost then chr(10) || '    residual ' || case lost_side when 'deposit' then '-' else '' end || gone || chr(10) || '    a ' || lost_side || ' of ' || gone || ' was not read' else '' end || chr(10) as body from c),
w as (
  select doc_id, period, 'amount_from_balance' as warning, n_recovered as n from h where n_recovered > 0 union all select doc_id, period, 'date_from_row_before', n_inherited from h where n_inherited > 0
  union all select doc_id, period, 'summary_table', 1 from h where account % 6 = 1 and period = 0 union all select doc_id, period, 'listing_added', n_listed from h where n_listed > 0
  union all select doc_id, period, 'listing_left_out', n_left from h where n_left > 0
  union all select doc_id, 0, 'no_text_layer', (select count(distinct page) from x where x.account = h.account) from h where account % 9 = 8 and period = 0),
v as (select doc_id, string_agg('warning: period ' || (period + 1) || ', ' || warning || ' (' || n || ')', chr(10) order by period, warning) as warned from w group by doc_id),
d as (select b.doc_id, string_agg(body, chr(10) order by period) as body, count(*) as n, any_value(account) as account, min(starts) as s, min(ends) as e from b group by 1),
n as (select doc_id, count(*) as n_rows from t group by 1)
select doc_id, concat_ws(chr(10), doc_id, repeat('=', length(doc_id)), ['HARBOUR BANK', 'Union Trust', 'First Mutual Savings'][(account % 3 + 1)::int] || ' · account ' || lpad((account % 10000)::varchar, 4, '0') || ' · ' || s || ' to ' || e,
  n || ' period(s), ' || n_rows || ' transaction(s)', '', body, 'path: deterministic', warned) as text from d join n using (doc_id) left join v using (doc_id)""")
def extract_text_reports(spark, sf):
    """The report a reader gets of each document, warnings and all."""
    return sinks.text_reports(extracted(spark, sf))


_ASKED = """q as (
  select account, period, event_id as request, ['state', 'find_amount', 'list_rows', 'find_amount'][(event_id % 4 + 1)::int] as kind, cents + (event_id % 8 = 3)::bigint as cents, event_id % 9 as first from l where event_id % 6 = 1 or event_id % 8 = 3)"""


@query(f"""with {L}, {P}, {F0}, {F2}, {T}, {C}, {_ASKED},
r as (select *, row_number() over (partition by account, period order by ts, event_id, side) - 1 as i from p),
s as (select account, period, day(ts) as page, cents from l)
select q.account, q.period, request, kind, case when kind = 'state' then reconciled end as reconciled, case when kind = 'state' then residual end::bigint as residual, case when kind = 'state' then dep_n + wd_n end::bigint as n_rows,
  case when kind = 'find_amount' then coalesce((select string_agg(distinct page::varchar, ',' order by page::varchar) from s where s.account = q.account and s.period = q.period and s.cents = q.cents), '') else '' end as on_pages,
  case kind when 'find_amount' then coalesce((select string_agg(i::varchar, ',' order by i) from r where r.account = q.account and r.period = q.period and r.cents = q.cents), '')
            when 'list_rows' then coalesce((select string_agg(i::varchar, ',' order by i) from r where r.account = q.account and r.period = q.period and i >= q.first and i < q.first + 20), '') else '' end as row_indexes
from q left join c using (account, period)""")
def ledger_requests(spark, sf):
    """State, amounts and rows asked of many periods at once; some amounts are nowhere."""
    c = F.col
    full = ledger(spark, sf)
    read = parsed(full)
    order = statements.Window.partitionBy(*KEYS).orderBy("ts", "event_id", "side")
    rows_ = read.select(*KEYS, (F.row_number().over(order) - 1).cast("int").alias("row_index"), F.to_date("ts").alias("date"), F.concat(F.lit("E"), c("event_id").cast("string")).alias("description"), "side", "cents")
    asked = full.where("event_id % 6 = 1 or event_id % 8 = 3")
    kind = F.element_at(F.array(*map(F.lit, ("state", "find_amount", "list_rows", "find_amount"))), (c("event_id") % 4 + 1).cast("int"))
    amount = money.format_cents(c("cents") + (c("event_id") % 8 == 3).cast("bigint"))
    asked = asked.select(*KEYS, c("event_id").alias("request"), kind.alias("kind"), amount.alias("amount"), (c("event_id") % 9).cast("int").alias("first"), F.lit(None).cast("int").alias("until"), F.lit(None).cast("int").alias("number"))
    shown = full.select(*KEYS, F.dayofmonth("ts").alias("page"), "cents")
    pages = shown.groupBy(*KEYS, "page").agg(F.array_join(F.array_sort(F.collect_list(money.format_cents(c("cents")))), "\n").alias("text"))
    out = requests.answers(asked, reconcile.reconcile(printed(full), read, KEYS), rows_, shown, pages, KEYS)
    listed = lambda x: F.array_join(x, ",")
    return out.select(*KEYS, "request", "kind", "reconciled", "residual", "n_rows", listed(F.array_sort(F.transform("on_pages", lambda p: p.cast("string")))).alias("on_pages"), listed(F.transform("row_indexes", lambda i: i.cast("string"))).alias("row_indexes"))


@query(f"""{STATED} select doc_id, period, 1 as layout, 1 + (n_listed + n_left > 0)::int::bigint as readings from h where not lost""")
def extract_frontier(spark, sf):
    """Readings that closed periods took: one layout, with its listings and without;
    later layouts are tried on open periods alone."""
    found = extracted(spark, sf)
    closed = found["checks"].where("reconciled").select("doc_id", "period")
    return found["attempts"].join(closed, ["doc_id", "period"]).groupBy("doc_id", "period").agg(F.max("candidate").alias("layout"), F.count(F.lit(1)).alias("readings"))


# ------------------------------------------------------------------ repair, usage, edges
def repair_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of edits for the periods that lost a row, by account: the row at once; a
    wrong amount; a wrong amount, dropped again beside the right one; turns too dear;
    none."""
    c = F.col
    lost = statements.facts(spark, sf).where("lost").withColumn("k", (F.floor(c("account") / 11) % 5).cast("int"))
    call = lambda name, **args: F.struct(F.lit(name).alias("name"), F.to_json(F.struct(*[v.alias(k) for k, v in args.items()])).alias("arguments"))
    amount = lambda v: statements.shown(v)
    insert = lambda v: call("insert_row", when=F.date_format("day", "yyyy-MM-dd"), description=F.concat(F.lit("PAYMENT E"), c("event_id").cast("string")), side=c("side"), amount=amount(v))
    look = F.array(call("find_amount", amount=amount(c("cents"))))
    wrong, right = insert(c("cents") + 1), insert(c("cents"))
    # The lost row is the last of its period, so the first row put in is at the place it had.
    again = F.array(call("drop_row", index=(c("rows") - 1).cast("bigint")), right)
    script = F.when(c("k") == 0, F.array(look, F.array(right))).when(c("k") == 1, F.array(F.array(wrong))).when(c("k") == 2, F.array(look, F.array(wrong), again)).otherwise(F.array(F.slice(look, 1, 0), F.array(right)))
    dear = (c("account") % 2 == 1) & (c("k") == 0)
    turns = lost.select(c("account").cast("string").alias("doc_id"), c("half").alias("period"), F.posexplode(script).alias("turn", "calls"), dear.alias("dear"))
    return turns.select("doc_id", "period", "turn", F.when(c("dear"), 1_000_000).otherwise(1_000).alias("tokens_in"), F.lit(200).alias("tokens_out"), "calls")


@query(f"""{STATED}, m as (select *, lost and ((account // 11) % 5 = 0 and account % 2 = 0 or (account // 11) % 5 = 2) as mended from h),
n as (select account::varchar as doc_id, half as period, count(*) as n_rows from x group by all)
select doc_id, period, case when mended then 'repaired' else 'deterministic' end as path, mended or not lost as reconciled, n_rows - (lost and not mended)::int::bigint as n_rows,
  case when lost and not mended then case lost_side when 'deposit' then -lost_cents else lost_cents end else 0 end::bigint as residual,
  case when lost then case (account // 11) % 5 when 0 then case when account % 2 = 0 then 2 else 1 end when 1 then 1 when 2 then 3 else 1 end end::bigint as calls,
  case when mended then case (account // 11) % 5 when 0 then 1 else 3 end end::bigint as n_edits from m join n using (doc_id, period)""")
def extract_repaired(spark, sf):
    """Edits kept only where the period closes within its turns and budget."""
    found = extract(statements.render(spark, sf), turns=repair_turns(spark, sf), prices=(0.3, 1.2))
    edits = found["warnings"].where("warning = 'rows_repaired'").select("doc_id", "period", F.col("n").alias("n_edits"))
    both = found["checks"].join(found["usage"].select("doc_id", "period", "calls"), ["doc_id", "period"], "left").join(edits, ["doc_id", "period"], "left")
    return both.select("doc_id", "period", "path", "reconciled", (F.col("dep_n") + F.col("wd_n")).alias("n_rows"), "residual", "calls", "n_edits")


@query(f"""with {L}, {P}, {F0}, q as (select account, period, event_id, any_value(side) as side, any_value(cents) as cents from p group by all),
n as (select account, period, coalesce(sum(cents) filter (side = 'deposit'), 0) - coalesce(sum(cents) filter (side = 'withdrawal'), 0) as net from l where cents <> 0 group by all),
e as (select distinct account, period from l where (event_id % 197 = 5 or event_id % 211 = 7) and cents <> 0),
w as (select account, period, bool_or(event_id % 5 = 0) as spoilt from l where (event_id % 197 = 5 or event_id % 211 = 7) and cents <> 0 group by all),
r as (select e.* from e join w using (account, period) where not spoilt)
select account, period, event_id, l.side, cents, true as repaired from l join r using (account, period) where cents <> 0
union all select account, period, event_id, side, cents, false from q where not exists (select 1 from r where r.account = q.account and r.period = q.period)""")
def repair_accepted(spark, sf):
    """Edits stay where the period then reconciles; of some an amount is wrong."""
    full = ledger(spark, sf).where("cents <> 0")
    lost, flipped = F.col("event_id") % 197 == 5, F.col("event_id") % 211 == 7
    edits = full.where(lost | flipped).withColumn("op", F.when(lost, "insert").otherwise("set_side"))
    wrong = F.col("event_id") % 5 == 0
    edits = edits.withColumn("cents", F.when(wrong & lost, F.col("cents") + 1).otherwise(F.col("cents"))).withColumn("side", F.when(wrong & ~lost, F.when(F.col("side") == "deposit", "withdrawal").otherwise("deposit")).otherwise(F.col("side")))
    return rows.repaired(parsed(full).dropDuplicates(["event_id"]), edits, printed(full, hide=False), KEYS, "event_id").select(*KEYS, "event_id", "side", "cents", "repaired")


@query("""with t as (select conv_id, turn, length(text) as n, role = 'assistant' as out from conversations),
s as (select conv_id, count(*) as calls, coalesce(sum(n) filter (not out), 0)::bigint as tokens_in, coalesce(sum(n) filter (out), 0)::bigint as tokens_out from t group by 1)
select conv_id, calls, tokens_in, tokens_out, (tokens_in * 0.15::double + tokens_out * 0.6::double) / 1000000 as cost_usd from s""")
def usage_costs(spark, sf):
    """What model calls took, a conversation being a run, a character a token."""
    said = table(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "assistant", 0).otherwise(F.length("text")).alias("tokens_in"), F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).alias("tokens_out"))
    return evaluation.usage(said, ["conv_id"], 0.15, 0.6)


@query("""select event_id, case when event_id % 3 <> 1 then (props ->> '$.k')::bigint end as k, case when event_id % 3 = 2 then event_type end as kind from events""")
def tool_arguments(spark, sf):
    """Arguments as JSON, off the events' own; what is cut off is an empty object."""
    c = F.col
    more = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "kind": "'), c("event_type"), F.lit('"}'))
    raw = F.when(c("event_id") % 3 == 0, c("props")).when(c("event_id") % 3 == 1, F.expr("left(props, length(props) - 1)")).otherwise(more)
    return table(spark, sf, "events").select("event_id", evaluation.arguments(raw, "k bigint, kind string").alias("a")).select("event_id", "a.k", "a.kind")


@query("""select doc_id, case when length(trim(text)) >= 20 then case when doc_id % 3 = 0 then 'ocr' else 'text' end else 'empty' end as kind, length(trim(text)) < 20 or doc_id % 3 = 0 as scanned from documents""")
def page_kinds(spark, sf):
    kind = edges.page_kind(F.col("text"), F.col("doc_id") % 3 == 0)
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind")).withColumn("scanned", edges.is_scanned(F.col("kind")))


# ------------------------------------------------------------------ functions and recognised text
@query("""select o_orderkey, case o_orderkey % 7 when 5 then null when 6 then null when 2 then 'MMM d, yyyy' when 3 then 'd MMM yy' when 4 then 'M/d' when 1 then 'yyyy-M-d' else 'M/d/yyyy' end as notation from orders""")
def date_notations(spark, sf):
    """Human date formats as notations; what can't be read as one is null."""
    shapes = ["MM/DD/YYYY", "YYYY-MM-DD", "MMMM DD, YYYY", "DD MON YY", "MM/DD", "dated DD", "////"]
    given = F.element_at(F.array(*map(F.lit, shapes)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", dates.notation_of(given).alias("notation"))


@query("""with d as (select o_orderkey, cast(o_orderdate as date) as d, (o_orderkey % 16)::int as k from orders)
select o_orderkey, case when k in (12, 13, 14) then make_date(1904, month(d)::int, day(d)::int) when k = 15 then null else d end as date, case when k = 15 then 0 else 2 end as n_found,
  case when k in (12, 13, 14) then make_date(1904, month(d)::int, day(d)::int) when k = 15 then null else d end as last_found from d""")
def date_forms(spark, sf):
    """Every notation, with glued commas, marks behind and range hyphens."""
    day = F.col("o_orderdate").cast("timestamp")
    shapes = ["MM/dd/yyyy", "M/d/yy", "M-d-yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d,yyyy", "MMMM d yyyy", "MMM d yyyy:", "d MMMM yyyy", "d MMM yyyy.", "d MMMM yy", "d MMM yy;", "M/d", "MMM d", "d MMM", "M.d.yyyy"]
    shown = F.date_format(day, shapes[0])
    for k, f in enumerate(shapes[1:], 1):
        mark = f[-1] if f[-1] in ":.;" else ""
        shown = F.when(F.col("o_orderkey") % 16 == k, F.concat(F.date_format(day, f.rstrip(":.;")), F.lit(mark))).otherwise(shown)
    named = (F.col("o_orderkey") % 16).isin(4, 5, 6)
    between = F.when(named, F.lit("-")).otherwise(F.lit(" to "))
    found = dates.find_dates(F.concat(F.lit("from "), shown, between, shown))
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("shown"), found.alias("found")).select("o_orderkey", dates.parse_date(F.col("shown")).alias("date"), F.size("found").alias("n_found"), F.try_element_at("found", F.lit(-1)).alias("last_found"))


@query("""with c as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as c, (o_orderkey % 4)::int as k from orders)
select o_orderkey, i::int as i, t as text, round(10.0::double + s * w, 6) as x0, round(20.0::double + s * w / 10, 6) as top from (
  select o_orderkey, unnest(range(len(ts))) as i, unnest(ts) as t, unnest(list_transform(range(len(ts)), lambda j: list_sum(list_transform(ts[1:j], lambda y: length(y)))))::double as before, total from (
    select o_orderkey, ts, list_sum(list_transform(ts, lambda y: length(y))) as total from (
      select o_orderkey, case k when 0 then ['Total', 'Paid', '2024', (c // 100 % 1000) || '.' || lpad((c % 100)::varchar, 2, '0')] when 1 then ['**', '1234', '12,345.67'] when 2 then ['Ixonia', '11.20'] else ['Life', '01/21'] end as ts from c)))
  , lateral (select coalesce(before, 0) / total as s, 100.0::double as w)""")
def recognised_words(spark, sf):
    """Recognised stretches of text as words: cut at the borders of kinds of
    characters, misread marks put right, boxes shared out along a rising line."""
    c = money.cents(F.col("o_totalprice"))
    k = F.col("o_orderkey") % 4
    body = F.concat((F.floor(c / 100) % 1000).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    said = F.when(k == 0, F.concat(F.lit("TotalPaid:2024 "), body)).when(k == 1, "**1234 12/345.67").when(k == 2, "Ixonia 1|.20").otherwise("Life 0|/2|")
    segments = table(spark, sf, "orders").select("o_orderkey", said.alias("text"), F.lit(20.0).alias("x0"), F.lit(220.0).alias("x1"), F.lit(40.0).alias("top"), F.lit(80.0).alias("bottom"), F.lit(20.0).alias("rise"), F.when(k == 3, 0.5).otherwise(0.9).alias("score"))
    sure = segments.unionByName(segments.withColumn("score", F.lit(0.4)))
    out = recognised.words_of_segments(sure, ["o_orderkey"], 2.0)
    return out.select("o_orderkey", "i", "text", F.round("x0", 6).alias("x0"), F.round("top", 6).alias("top"))


@query(f"""with {L} select event_id, case when event_id % 5 = 3 then [] else [cents] end::varchar as cents, case when event_id % 5 = 3 then 0 else 1 end as n from l""")
def fragment_amounts(spark, sf):
    """Amounts split over touching boxes; boxes that stand apart are none."""
    full = ledger(spark, sf)
    shown = money.format_cents(F.col("cents"))
    kind = F.col("event_id") % 5
    head, tail = F.substring(shown, F.lit(1), F.length(shown) - 3), F.right(shown, F.lit(2))
    parts = F.when(kind == 0, F.array(shown)).when(kind == 1, F.array(head, F.concat(F.lit("."), tail))).when(kind == 2, F.array(head, F.lit("."), tail)).when(kind == 3, F.array(head, F.concat(F.lit("."), tail))).otherwise(F.array(head, tail))
    gap = F.when(kind == 3, 9.0).otherwise(0.5)
    boxes = F.transform(parts, lambda t, i: F.struct(t.alias("text"), (100.0 + i * (30.0 + gap)).alias("x0"), (130.0 + i * (30.0 + gap)).alias("x1")))
    read = full.select("event_id", scan.amounts(boxes).alias("found"))
    return read.select("event_id", F.concat(F.lit("["), F.array_join(F.transform("found", lambda m: m["cents"].cast("string")), ", "), F.lit("]")).alias("cents"), F.size("found").alias("n"))


@query("""select l_orderkey, l_linenumber, case l_returnflag when 'N' then 2 when 'A' then 2 + l_linenumber end::int as slots, case when l_returnflag = 'R' then null else l_returnflag = 'N' end as is_check from lineitem""")
def listing_headers(spark, sf):
    """Headers of as many groups as a line's number says, with checks or without; some
    are of a table and no listing."""
    c = F.col
    group = F.split(F.when(c("l_returnflag") == "N", "Date Check No. Amount").otherwise("Date Amount"), " ")
    said = F.when(c("l_returnflag") == "R", F.split(F.lit("Date Description Amount Balance"), " ")).otherwise(F.flatten(F.array_repeat(group, F.when(c("l_returnflag") == "N", 2).otherwise(2 + c("l_linenumber")).cast("int"))))
    boxes = F.transform(said, lambda t, i: F.struct(t.alias("text"), (i * 50.0).alias("x0"), (i * 50.0 + 40.0).alias("x1")))
    found = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", listing.header_of(boxes).alias("h"))
    return found.select("l_orderkey", "l_linenumber", F.when(c("h").isNotNull(), F.size("h.slots")).alias("slots"), c("h.check").alias("is_check"))


@query("""select p_partkey, case when p_size % 2 = 0 then 'deposit' when contains(p_name, 'gear') or contains(p_name, 'bolt') then 'withdrawal' end as side from part""")
def heading_sides(spark, sf):
    """Headings of a part's own words, with a label of a side or a word that holds one."""
    c = F.col
    label = F.when(c("p_size") % 2 == 0, "DEPOSITS AND CREDITS").when(c("p_name").contains("gear") | c("p_name").contains("bolt"), "Checks paid").otherwise("Predeposits")
    return table(spark, sf, "part").select("p_partkey", text.heading_side(F.concat_ws(" ", "p_name", label, "p_type")).alias("side"))


@query(f"""with {L} select account::varchar as doc_id, case when account % 2 = 0 then 0.01 else 0.0 end::double as slope from l group by account having count(*) * 4 >= 30""")
def page_skew(spark, sf):
    """Tilt of pages of rows of four words each, by the two-step search."""
    full = ledger(spark, sf)
    place = F.struct("account", "ts", "event_id")
    nth = full.select(F.col("account").cast("string").alias("doc_id"), F.lit(1).alias("page"), "account", F.row_number().over(statements.Window.partitionBy("account").orderBy("ts", "event_id")).alias("n"), place.alias("p"))
    words = nth.select("doc_id", "page", "account", "n", F.explode(F.array(F.lit(40.0), F.lit(131.0), F.lit(289.0), F.lit(440.0))).alias("x0"))
    tilt = F.when(F.col("account") % 2 == 0, 0.01).otherwise(0.0)
    words = words.select("doc_id", "page", "x0", (F.col("n") * 12.0 + 0.5 + F.col("x0") * tilt).alias("top"))
    return geometry.skew(words, ["doc_id", "page"]).select("doc_id", F.round("slope", 2).alias("slope"))


@query(f"""{STATED} select doc_id, period, case when lost then case lost_side when 'deposit' then -lost_cents else lost_cents end else 0 end::bigint as residual, not lost as reconciled from h where account % 3 = 1""")
def stream_checks(spark, sf):
    """A third of the statements as a stream of words: closed by their timers, read as
    they close. The last words that come only move time on."""
    words = statements.render(spark, sf).where(F.col("doc_id").cast("bigint") % 3 == 1)
    coming, out = place(spark, "words"), place(spark, "read")
    documents.with_arrival(words).write.parquet(coming)
    spark.read.parquet(coming).limit(1).withColumns({"doc_id": F.lit("~"), "arrived": F.lit("2024-03-01").cast("timestamp")}).write.mode("append").parquet(coming)
    stream = spark.readStream.schema(spark.read.parquet(coming).schema).parquet(coming)
    documents.read_documents(stream, out, place(spark, "stream"), ("checks",)).awaitTermination()
    return documents.results(spark, out, "checks").select("doc_id", "period", "residual", "reconciled")
