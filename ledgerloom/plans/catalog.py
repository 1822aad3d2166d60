"""Registered queries of the ledger engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators import audit, diagnose, geometry, reconcile, rows
from ledgerloom.plans.ledger import KEYS, OPENING, ledger, parsed, printed, table
from ledgerloom.sources import words as edges
from ledgerloom.sources.shared import written
from ledgerloom.streaming import tieout

ORACLES: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Shared parts of the SQL: ledger, parsed rows, printed figures, checks.
L = """l as (
  select user_id as account, cast(date_trunc('week', ts) as date) as period, event_id, ts, cast(round(value * 100) as bigint) as cents,
         case when event_type in ('purchase', 'signup') then 'deposit' else 'withdrawal' end as side from events)"""
P = """p as (
  select account, period, event_id, ts, cents,
         case when event_id % 211 = 7 then case side when 'deposit' then 'withdrawal' else 'deposit' end else side end as side
  from l, (values (1), (2)) c(n) where event_id % 197 <> 5 and cents <> 0 and (n = 1 or event_id % 199 = 11))"""
F0 = f"""f0 as (
  select account, period, coalesce(sum(cents) filter (side = 'deposit'), 0)::bigint as deposits_total, coalesce(sum(cents) filter (side = 'withdrawal'), 0)::bigint as withdrawals_total,
         count(*) filter (side = 'deposit') as deposits_count, count(*) filter (side = 'withdrawal') as withdrawals_count, {OPENING}::bigint as beginning from l group by all),
f1 as (select *, beginning + deposits_total - withdrawals_total as ending from f0)"""
F2 = """f as (
  select account, period, case when account % 6 not in (2, 3, 4) then beginning end as beginning, case when account % 6 not in (2, 3, 4) then ending end as ending,
         case when account % 6 not in (0, 3, 4) then deposits_total end as deposits_total, case when account % 6 not in (0, 3, 4) then withdrawals_total end as withdrawals_total,
         case when account % 6 not in (1, 3) then deposits_count end as deposits_count, case when account % 6 not in (1, 3) then withdrawals_count end as withdrawals_count from f1)"""
T = """t as (
  select account, period, coalesce(sum(cents) filter (side = 'deposit'), 0)::bigint as dep_cents, coalesce(sum(cents) filter (side = 'withdrawal'), 0)::bigint as wd_cents,
         count(*) filter (side = 'deposit') as dep_n, count(*) filter (side = 'withdrawal') as wd_n from p group by all)"""
C = """b as (
  select f.*, coalesce(dep_cents, 0) as dep_cents, coalesce(wd_cents, 0) as wd_cents, coalesce(dep_n, 0) as dep_n, coalesce(wd_n, 0) as wd_n from f left join t using (account, period)),
c0 as (
  select *, coalesce(beginning, 0) + dep_cents - wd_cents - coalesce(ending, coalesce(beginning, 0) + coalesce(deposits_total, dep_cents) - coalesce(withdrawals_total, wd_cents)) as residual,
         case when beginning + deposits_total - withdrawals_total = ending then 'ok' when beginning + deposits_total - withdrawals_total <> ending then 'fail' else 'unavailable' end as check_printed_block_closes,
         case when beginning + dep_cents - wd_cents = ending then 'ok' when beginning + dep_cents - wd_cents <> ending then 'fail' else 'unavailable' end as check_balance_equation,
         case when dep_cents = deposits_total then 'ok' when dep_cents <> deposits_total then 'fail' else 'unavailable' end as check_deposits_total,
         case when wd_cents = withdrawals_total then 'ok' when wd_cents <> withdrawals_total then 'fail' else 'unavailable' end as check_withdrawals_total,
         case when dep_n = deposits_count then 'ok' when dep_n <> deposits_count then 'fail' else 'unavailable' end as check_deposits_count,
         case when wd_n = withdrawals_count then 'ok' when wd_n <> withdrawals_count then 'fail' else 'unavailable' end as check_withdrawals_count from b),
c1 as (
  select *, list_filter([check_printed_block_closes, check_balance_equation, check_deposits_total, check_withdrawals_total, check_deposits_count, check_withdrawals_count], lambda x: x = 'ok') as oks,
         list_filter([check_printed_block_closes, check_balance_equation, check_deposits_total, check_withdrawals_total, check_deposits_count, check_withdrawals_count], lambda x: x = 'fail') as fails from c0),
c2 as (
  select *, len(oks) as n_ok, len(fails) as n_fail,
         len(fails) = 0 and (check_balance_equation = 'ok' or check_deposits_total = 'ok' and check_withdrawals_total = 'ok') as reconciled from c1),
c as (
  select *, case when reconciled or n_fail > 0 then null when n_ok = 0 then 'no_printed_summary' else 'no_transaction_evidence' end as structural from c2)"""
S = """s as (
  select *, dep_n - deposits_count as dd, wd_n - withdrawals_count as dw from c),
g as (
  select *, case when dd = -1 and dw = 0 and -residual > 0 then 'dropped_row' when dd = 0 and dw = -1 and residual > 0 then 'dropped_row'
              when dd = 1 and dw = 0 and residual > 0 then 'duplicated_row' when dd = 0 and dw = 1 and -residual > 0 then 'duplicated_row'
              when dd = -1 and dw = 1 and -residual > 0 then 'side_flip' when dd = 1 and dw = -1 and residual > 0 then 'side_flip' end as sig_kind,
         case when dd = -1 and dw = 0 and -residual > 0 then 'deposit' when dd = 0 and dw = -1 and residual > 0 then 'withdrawal'
              when dd = 1 and dw = 0 and residual > 0 then 'deposit' when dd = 0 and dw = 1 and -residual > 0 then 'withdrawal'
              when dd = -1 and dw = 1 and -residual > 0 then 'deposit' when dd = 1 and dw = -1 and residual > 0 then 'withdrawal' end as sig_side,
         case when sig_kind = 'side_flip' then abs(residual) / 2.0 else abs(residual) * 1.0 end::double as sig_amount from s),
m as (
  select g.*, abs(residual) as mag,
         abs(residual) % 2 = 0 and exists (select 1 from p where p.account = g.account and p.period = g.period and p.cents = abs(g.residual) // 2) as half_row,
         exists (select 1 from p where p.account = g.account and p.period = g.period and p.cents = abs(g.residual)) as whole_row,
         (select min(event_id % 7) from l where l.account = g.account and l.period = g.period and l.cents = abs(g.residual)) as page from g),
d as (
  select *, case when reconciled then null when structural is not null then structural
              when residual = 0 and (dd < 0 or dw < 0) then 'zero_amount_rows' when residual = 0 and dd is not null and dw is not null then 'surplus_rows'
              when sig_kind is not null then sig_kind when half_row then 'side_flip' when whole_row then 'amount_matches_row' when page is not null then 'dropped_row' else 'unknown' end as diagnosis,
         case when reconciled or structural is not null or (residual = 0 and dd is not null and dw is not null) then null when sig_kind is not null then sig_side end as diag_side,
         case when reconciled or structural is not null or (residual = 0 and dd is not null and dw is not null) then null when sig_kind is not null then sig_amount
              when half_row then mag / 2.0 when whole_row then mag when page is not null then mag end::double as diag_amount,
         case when reconciled then null when structural is not null then true when residual = 0 and (dd < 0 or dw < 0) then true when residual = 0 and dd is not null and dw is not null then false
              when sig_kind is not null then true else false end as confident from m)"""
A = """a0 as (
  select *, deposits_count is not null and withdrawals_count is not null as bounded,
         case when deposits_count is not null and withdrawals_count is not null then deposits_count - dep_n end as missing_deposits,
         case when deposits_count is not null and withdrawals_count is not null then withdrawals_count - wd_n end as missing_withdrawals,
         dep_cents - deposits_total as in_difference, wd_cents - withdrawals_total as out_difference,
         (select count(*) from l where l.account = d.account and l.period = d.period and event_id % 401 = 3) as n_doubts from d),
a1 as (
  select *, case when in_difference is null or out_difference is null then 'not_printed' when in_difference = 0 and out_difference = 0 then 'both_agree'
              when in_difference <> 0 and out_difference <> 0 then 'both_differ' when out_difference = 0 then case when in_difference < 0 then 'in_short' else 'in_over' end
              else case when out_difference < 0 then 'out_short' else 'out_over' end end as where_to_look,
         case when residual = 0 then 'none' when diagnosis in ('dropped_row', 'duplicated_row', 'side_flip', 'zero_amount_rows', 'surplus_rows', 'row_level_break', 'amount_matches_row') then 'extraction_uncertainty'
              when n_doubts = 0 and diagnosis is null then 'statement_inconsistency' else 'unexplained' end as attribution from a0),
a as (
  select *, case when reconciled then case when bounded and n_doubts = 0 then 'tied' else 'tied_with_notes' end when attribution = 'unexplained' then 'not_tied' else 'exceptions_identified' end as verdict,
         case verdict when 'tied' then 0 when 'tied_with_notes' then 1 when 'exceptions_identified' then 2 else 3 end as severity from a1)"""
CHECKED = f"with {L}, {P}, {F0}, {F2}, {T}, {C}"
DIAGNOSED = f"{CHECKED}, {S}"
AUDITED = f"{DIAGNOSED}, {A}"
NAMES = ", ".join(f"check_{x}" for x in reconcile.CHECKS)


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    full = ledger(spark, sf)
    return reconcile.reconcile(printed(full), parsed(full), KEYS)


def _diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    full = ledger(spark, sf)
    pages = full.select(*KEYS, "cents", (F.col("event_id") % 7).alias("page"))
    # Written: read for what is wanted and for the result.
    checks = written(diagnose.count_signature(_checks(spark, sf)), "checks")
    return diagnose.diagnose(diagnose.residual_matches(checks, parsed(full), pages, KEYS))


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    doubts = ledger(spark, sf).groupBy(*KEYS).agg(F.count_if(F.col("event_id") % 401 == 3).alias("doubted"))
    out = audit.sides(audit.completeness(_diagnosed(spark, sf))).join(doubts, KEYS, "left").fillna(0, ["doubted"])
    return audit.verdict(audit.attribution(out, F.col("doubted")))


# ------------------------------------------------------------------ reconcile, diagnose, audit
@query(f"with {L}, {P}, {T} select * from t")
def period_totals(spark, sf):
    return reconcile.totals(parsed(ledger(spark, sf)), KEYS)


@query(f"{CHECKED} select account, period, residual, {NAMES}, n_ok::int as n_ok, reconciled from c")
def recon_checks(spark, sf):
    return _checks(spark, sf).select(*KEYS, "residual", *[f"check_{x}" for x in reconcile.CHECKS], "n_ok", "reconciled")


@query(f"{CHECKED} select account, period, reconciled, structural from c")
def recon_structural(spark, sf):
    return _checks(spark, sf).select(*KEYS, "reconciled", "structural")


@query(f"{DIAGNOSED} select account, period, residual, diagnosis, diag_side, diag_amount, confident from d")
def residual_diagnosis(spark, sf):
    return _diagnosed(spark, sf).select(*KEYS, "residual", "diagnosis", "diag_side", "diag_amount", "confident")


@query(f"{DIAGNOSED} select account, period, half_row, whole_row, page from m where residual <> 0")
def residual_alone(spark, sf):
    return _diagnosed(spark, sf).where("residual <> 0").select(*KEYS, "half_row", "whole_row", "page")


@query(f"""with {L}, r as (select *, case side when 'deposit' then cents else -cents end as signed from l)
select account, event_id, signed, ({OPENING} + sum(signed) over (partition by account order by ts, event_id rows unbounded preceding))::bigint as balance from r""")
def running_balance(spark, sf):
    return rows.running_balance(ledger(spark, sf), ["account"], ["ts", "event_id"], F.lit(OPENING)).select("account", "event_id", "signed", "balance")


@query(f"""with {L}, r as (select *, case side when 'deposit' then cents else -cents end as signed from l),
b as (select *, ({OPENING} + sum(signed) over (partition by account order by ts, event_id rows unbounded preceding))::bigint + (event_id % 401 = 3)::bigint as balance from r),
x as (select *, row_number() over (partition by account order by ts, event_id) - 1 as row_index, balance - coalesce(lag(balance) over (partition by account order by ts, event_id), {OPENING}) - signed as amount from b)
select account, min(row_index)::int as row_index, arg_min(amount, row_index)::bigint as amount from x where amount <> 0 group by account""")
def chain_first_break(spark, sf):
    full = rows.running_balance(ledger(spark, sf), ["account"], ["ts", "event_id"], F.lit(OPENING))
    off = full.withColumn("balance", F.col("balance") + (F.col("event_id") % 401 == 3).cast("bigint"))
    return diagnose.chain_breaks(off, ["account"], ["ts", "event_id"], F.lit(OPENING))


@query(f"{AUDITED} select account, period, bounded, missing_deposits, missing_withdrawals from a")
def audit_completeness(spark, sf):
    return audit.completeness(_checks(spark, sf)).select(*KEYS, "bounded", "missing_deposits", "missing_withdrawals")


@query(f"{AUDITED} select account, period, in_difference, out_difference, where_to_look from a")
def audit_sides(spark, sf):
    return audit.sides(_checks(spark, sf)).select(*KEYS, "in_difference", "out_difference", "where_to_look")


@query(f"{AUDITED} select account, period, attribution, n_doubts from a")
def audit_attribution(spark, sf):
    return _audited(spark, sf).select(*KEYS, "attribution", "n_doubts")


@query(f"{AUDITED} select account, period, verdict, severity::int as severity from a")
def audit_verdict(spark, sf):
    return _audited(spark, sf).select(*KEYS, "verdict", "severity")


@query(f"""{AUDITED} select account, period, attribution as kind, residual as amount,
  'Residual ' || case when residual < 0 then '-' else '' end || (abs(residual) // 100) || '.' || lpad((abs(residual) % 100)::varchar, 2, '0') || ': ' || coalesce(diagnosis, 'none') as description from a where residual <> 0""")
def audit_exceptions(spark, sf):
    return audit.residual_exceptions(_audited(spark, sf), KEYS).select(*KEYS, "kind", "amount", "description")


@query(f"""{AUDITED} select account, period, array_to_string(list_filter([
  'verdict:' || verdict, case when coalesce(in_difference, 0) <> 0 or coalesce(out_difference, 0) <> 0 then 'look:' || where_to_look end,
  case when not bounded then 'confirm_population' when missing_deposits <> 0 or missing_withdrawals <> 0 then 'recover_rows:' || (coalesce(missing_deposits, 0) + coalesce(missing_withdrawals, 0)) end,
  case when attribution = 'statement_inconsistency' then 'finding_on_statement' end, case when n_doubts > 0 then 'vouch:' || n_doubts end], lambda x: x is not null), '; ') as steps from a""")
def audit_next_steps(spark, sf):
    return audit.next_steps(_audited(spark, sf)).select(*KEYS, F.array_join("steps", "; ").alias("steps"))


@query(f"{AUDITED} select account, arg_max(verdict, severity) as verdict, count(*) as periods, bool_and(reconciled) as reconciled, sum(residual)::bigint as residual from a group by account")
def audit_file_verdict(spark, sf):
    return audit.file_verdict(_audited(spark, sf), ["account"])


_WORST = ", ".join(f"['ok', 'unavailable', 'fail'][max(case check_{k} when 'ok' then 1 when 'unavailable' then 2 else 3 end)] as check_{k}" for k in reconcile.CHECKS)


@query(f"""{CHECKED} select account, count(*) as periods, bool_and(reconciled) as reconciled, sum(residual)::bigint as residual, arg_min(beginning, period) as beginning, arg_max(ending, period) as ending,
  sum(dep_cents)::bigint as dep_cents, sum(wd_cents)::bigint as wd_cents, sum(dep_n)::bigint as dep_n, sum(wd_n)::bigint as wd_n, {_WORST} from c group by account""")
def period_rollup(spark, sf):
    return reconcile.rollup(_checks(spark, sf), ["account"], "period")


# ------------------------------------------------------------------ ranking, variants, repair, evaluation
_CAND = f"""with {L}, {F0}, k as (select account, (event_id % 3)::int as candidate, side, cents, event_id from l where not (event_id % 3 = 0 and event_id % 17 = 1)),
t as (select account, candidate, coalesce(sum(cents) filter (side = 'deposit'), 0) - coalesce(sum(cents) filter (side = 'withdrawal'), 0) as net, count(*) as n, count(*) filter (event_id % 31 = 0) as n_recovered from k group by all),
w as (select account, (event_id % 3)::int as candidate, coalesce(sum(cents) filter (side = 'deposit'), 0) - coalesce(sum(cents) filter (side = 'withdrawal'), 0) as net, count(*) as n from l group by all),
r as (select t.account, t.candidate, t.net - w.net as residual, (t.net = w.net)::int + (t.n = w.n)::int as n_ok, t.net = w.net as reconciled, n_recovered from t join w using (account, candidate))"""


@query(f"""{_CAND}, x as (select *, row_number() over (partition by account order by reconciled desc, n_ok desc, n_recovered, abs(residual), candidate) as k from r)
select account, candidate, residual::bigint as residual, n_ok, reconciled, n_recovered from x where k = 1""")
def candidate_rank(spark, sf):
    full = ledger(spark, sf).withColumn("candidate", (F.col("event_id") % 3).cast("int"))
    net = F.sum(rows.signed()).alias("net")
    whole = full.groupBy("account", "candidate").agg(net, F.count(F.lit(1)).alias("n"))
    read = full.where("not (event_id % 3 = 0 and event_id % 17 = 1)").groupBy("account", "candidate").agg(F.sum(rows.signed()).alias("net_r"), F.count(F.lit(1)).alias("n_r"), F.count_if(F.col("event_id") % 31 == 0).alias("n_recovered"))
    both = read.join(whole, ["account", "candidate"]).select("account", "candidate", (F.col("net_r") - F.col("net")).alias("residual"), ((F.col("net_r") == F.col("net")).cast("int") + (F.col("n_r") == F.col("n")).cast("int")).alias("n_ok"), (F.col("net_r") == F.col("net")).alias("reconciled"), "n_recovered")
    return rows.best_candidate(both, ["account"])


@query(f"""with {L}, {F0}, v as (select 0 as candidate, * from l where event_id % 5 <> 0 or account % 2 = 0 union all select 1, * from l),
t as (select account, period, candidate, sum(case side when 'deposit' then cents else -cents end - case when account % 2 = 0 and candidate = 1 and event_id % 5 = 0 then cents else 0 end) as net from v group by all),
r as (select account, period, candidate, beginning + net - ending as residual from f1 join t using (account, period)),
x as (select *, row_number() over (partition by account, period order by residual = 0 desc, abs(residual), candidate) as k from r)
select account, period, candidate, residual::bigint as residual, residual = 0 as reconciled from x where k = 1""")
def listing_in_or_out(spark, sf):
    """A listing (every fifth row) is read with and without; the reading that ties stays."""
    full = ledger(spark, sf)
    listing = F.col("event_id") % 5 == 0
    repeats = F.col("account") % 2 == 0
    without = full.where(~listing | repeats).withColumn("candidate", F.lit(0)).withColumn("again", F.lit(0))
    merged = full.withColumn("candidate", F.lit(1)).withColumn("again", F.when(listing & repeats, F.col("cents")).otherwise(0))
    net = without.unionByName(merged).groupBy(*KEYS, "candidate").agg(F.sum(rows.signed() - F.col("again")).alias("net"))
    read = net.join(printed(full, hide=False), KEYS).withColumn("residual", F.col("beginning") + F.col("net") - F.col("ending"))
    ranked = read.select(*KEYS, "candidate", "residual", (F.col("residual") == 0).alias("reconciled"), F.lit(0).alias("n_ok"), F.lit(0).alias("n_recovered"))
    return rows.best_candidate(ranked, KEYS).select(*KEYS, "candidate", "residual", "reconciled")


@query(f"""with {L}, {P}, {F0}, e as (
  select account, period, case when event_id % 197 = 5 then 'insert' else 'set_side' end as op, event_id, side, cents from l where event_id % 197 = 5 or event_id % 211 = 7),
x as (select account, period, event_id, side, cents from (select distinct * from p) p where event_id not in (select event_id from e)
  union all select account, period, event_id, side, cents from e where cents <> 0),
u as (select account, period, coalesce(sum(cents) filter (side = 'deposit'), 0) - coalesce(sum(cents) filter (side = 'withdrawal'), 0) as net, count(*) as n_rows from x group by all)
select f1.account, f1.period, coalesce(n_rows, 0) as n_rows, (beginning + coalesce(net, 0) - ending)::bigint as residual, beginning + coalesce(net, 0) = ending as reconciled from f1 left join u using (account, period)""")
def repair_edits(spark, sf):
    """Edits that put back what was lost and turn what was flipped; doubles are dropped
    first. All edits stay here, whatever comes of them; ``repair_accepted`` and
    ``extract_repaired`` undo those of periods that don't close."""
    full = ledger(spark, sf)
    lost, flipped = F.col("event_id") % 197 == 5, F.col("event_id") % 211 == 7
    edits = full.where(lost | flipped).withColumn("op", F.when(lost, "insert").otherwise("set_side")).where("cents <> 0")
    fixed = rows.apply_edits(parsed(full).dropDuplicates(["event_id"]), edits, KEYS, "event_id")
    net = fixed.groupBy(*KEYS).agg(F.sum(rows.signed()).alias("net"), F.count(F.lit(1)).alias("n_rows"))
    out = printed(full, hide=False).join(net, KEYS, "left").fillna(0, ["net", "n_rows"]).withColumn("residual", F.col("beginning") + F.col("net") - F.col("ending"))
    return out.select(*KEYS, "n_rows", "residual", (F.col("residual") == 0).alias("reconciled"))


@query(f"""with {L}, {P}, {F0}, {T}, e as (unpivot (select account, period, deposits_total, withdrawals_total, deposits_count, withdrawals_count from f1) on deposits_total, withdrawals_total, deposits_count, withdrawals_count into name field value expected),
o as (unpivot (select account, period, dep_cents as deposits_total, wd_cents as withdrawals_total, dep_n as deposits_count, wd_n as withdrawals_count from t) on deposits_total, withdrawals_total, deposits_count, withdrawals_count into name field value observed)
select account, period, field, expected, observed, expected is not distinct from observed as same from e full join o using (account, period, field)""")
def eval_unpivot_diff(spark, sf):
    full = ledger(spark, sf)
    seen = reconcile.totals(parsed(full), KEYS).select(*KEYS, F.col("dep_cents").alias("deposits_total"), F.col("wd_cents").alias("withdrawals_total"), F.col("dep_n").alias("deposits_count"), F.col("wd_n").alias("withdrawals_count"))
    return rows.fields_diff(printed(full, hide=False), seen, KEYS, ["deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count"])


# ------------------------------------------------------------------ rows
@query(f"""with {L}, r as (select *, case side when 'deposit' then cents else -cents end as s from l),
b as (select *, ({OPENING} + sum(s) over (partition by account order by ts, event_id rows unbounded preceding))::bigint as balance, case when event_id % 31 <> 0 then s end as sg from r),
x as (select *, balance - coalesce(lag(balance) over (partition by account order by ts, event_id), {OPENING}) as step from b)
select account, event_id, balance, coalesce(sg, nullif(step, 0)) as signed, sg is null and step <> 0 as recovered from x""")
def balance_step_recovery(spark, sf):
    full = rows.running_balance(ledger(spark, sf), ["account"], ["ts", "event_id"], F.lit(OPENING))
    lost = full.withColumn("signed", F.when(F.col("event_id") % 31 != 0, F.col("signed")))
    return rows.balance_step(lost, ["account"], ["ts", "event_id"], F.lit(OPENING)).select("account", "event_id", "balance", "signed", "recovered")


@query(f"""with {L}, r as (select *, case when event_id % 29 <> 0 then cast(ts as date) end as dt from l)
select account, event_id, coalesce(dt, last_value(dt ignore nulls) over (partition by account, period order by ts, event_id rows between unbounded preceding and 1 preceding), period) as date, dt is null as date_inherited from r""")
def inherited_dates(spark, sf):
    read = ledger(spark, sf).withColumn("date", F.when(F.col("event_id") % 29 != 0, F.to_date("ts")))
    return rows.inherit_date(read, KEYS, ["ts", "event_id"], F.col("period")).select("account", "event_id", "date", "date_inherited")


@query(f"""with {L}, r as (select *, case when epoch(ts) - epoch(lag(ts) over (partition by account order by ts, event_id)) <= 21600 then 0 else 1 end as o from l)
select account, event_id, (sum(o) over (partition by account order by ts, event_id rows unbounded preceding))::bigint as segment from r""")
def period_segments(spark, sf):
    w = Window.partitionBy("account").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    opened = ledger(spark, sf).withColumn("opens", F.coalesce(gap > 21600 * 1_000_000, F.lit(True)))
    return rows.segments(opened, ["account"], ["ts", "event_id"], F.col("opens")).select("account", "event_id", "segment")


# One account holds nine tenths of the events; keys of more rows than these are read in blocks.
LARGE_KEY = 2_000
_HOT = f"""{L}, hot as (select *, case when account % 10 = 0 then account else 0 end as holder, case side when 'deposit' then cents else -cents end as signed from l)"""


def _hot(spark, sf):
    return ledger(spark, sf).withColumn("holder", F.when(F.col("account") % 10 == 0, F.col("account")).otherwise(0))


@query(f"""with {_HOT} select holder, event_id, ({OPENING} + sum(signed) over (partition by holder order by ts, event_id rows unbounded preceding))::bigint as balance from hot""")
def running_balance_hot(spark, sf):
    return rows.running_balance(_hot(spark, sf), ["holder"], ["ts", "event_id"], F.lit(OPENING), LARGE_KEY).select("holder", "event_id", "balance")


@query(f"""with {_HOT}, b as (select *, case when event_id % 17 <> 3 then ({OPENING} + sum(signed) over (partition by holder order by ts, event_id rows unbounded preceding))::bigint end as balance, case when event_id % 31 <> 0 then signed end as sg from hot),
x as (select *, balance - (case when row_number() over (partition by holder order by ts, event_id) = 1 then {OPENING} else coalesce(lag(balance) over (partition by holder order by ts, event_id), {OPENING}) end) as step from b)
select holder, event_id, coalesce(sg, nullif(step, 0)) as signed, sg is null and step <> 0 as recovered from x""")
def balance_recovery_hot(spark, sf):
    """Amounts off the balance step, where some rows print no balance either."""
    full = rows.running_balance(_hot(spark, sf), ["holder"], ["ts", "event_id"], F.lit(OPENING), LARGE_KEY)
    lost = full.withColumns({"signed": F.when(F.col("event_id") % 31 != 0, F.col("signed")), "balance": F.when(F.col("event_id") % 17 != 3, F.col("balance"))})
    return rows.balance_step(lost, ["holder"], ["ts", "event_id"], F.lit(OPENING), LARGE_KEY).select("holder", "event_id", "signed", "recovered")


@query(f"""with {_HOT}, r as (select *, case when event_id % 29 = 1 then cast(ts as date) end as dt from hot)
select holder, event_id, coalesce(dt, last_value(dt ignore nulls) over (partition by holder order by ts, event_id rows between unbounded preceding and 1 preceding), date '2024-01-01') as date, dt is null as date_inherited from r""")
def inherited_dates_hot(spark, sf):
    """One row in 29 has a date, so it is carried on over the borders of blocks."""
    read = _hot(spark, sf).withColumn("date", F.when(F.col("event_id") % 29 == 1, F.to_date("ts")))
    return rows.inherit_date(read, ["holder"], ["ts", "event_id"], F.lit("2024-01-01").cast("date"), LARGE_KEY).select("holder", "event_id", "date", "date_inherited")


@query(f"""with {_HOT} select holder, event_id, (sum(case when event_id % 101 = 7 then 1 else 0 end) over (partition by holder order by ts, event_id rows unbounded preceding))::bigint as segment from hot""")
def segments_hot(spark, sf):
    return rows.segments(_hot(spark, sf), ["holder"], ["ts", "event_id"], F.col("event_id") % 101 == 7, LARGE_KEY).select("holder", "event_id", "segment")


@query(f"with {L} select event_id, case when case side when 'deposit' then cents else -cents end < 0 then 'withdrawal' else 'deposit' end as side from l")
def side_signed(spark, sf):
    full = ledger(spark, sf)
    return full.select("event_id", rows.side_of("signed", rows.signed()).alias("side"))


@query(f"with {L} select event_id, case when event_id % 2 = 0 then 'deposit' else 'withdrawal' end as side from l")
def side_two_columns(spark, sf):
    return ledger(spark, sf).select("event_id", rows.side_of("two_columns", F.col("cents"), column=F.col("event_id") % 2).alias("side"))


@query(f"""with {L}, h as (select *, case when event_id % 13 = 0 then 'deposits' when event_id % 13 = 5 then 'withdrawals' end as head from l),
s as (select event_id, last_value(head ignore nulls) over (partition by account order by ts, event_id rows unbounded preceding) as section from h)
select event_id, section, case section when 'deposits' then 'deposit' when 'withdrawals' then 'withdrawal' end as side from s""")
def side_sections(spark, sf):
    w = Window.partitionBy("account").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("event_id") % 13 == 0, "deposits").when(F.col("event_id") % 13 == 5, "withdrawals")
    out = ledger(spark, sf).withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(w))
    return out.select("event_id", "section", rows.side_of("sections", F.col("cents"), section=F.col("section")).alias("side"))


@query(f"""with {L}, b as (select *, ({OPENING} + sum(case side when 'deposit' then cents else -cents end) over (partition by account order by ts, event_id rows unbounded preceding))::bigint as balance from l),
x as (select *, lag(balance) over (partition by account order by ts, event_id) as before from b)
select event_id, case when before is null then null when balance > before then 'deposit' else 'withdrawal' end as side from x""")
def side_balance_delta(spark, sf):
    full = rows.running_balance(ledger(spark, sf), ["account"], ["ts", "event_id"], F.lit(OPENING))
    out = full.withColumn("before", F.lag("balance").over(Window.partitionBy("account").orderBy("ts", "event_id")))
    return out.select("event_id", rows.side_of("balance_delta", F.col("cents"), before=F.col("before"), balance=F.col("balance")).alias("side"))


@query(f"with {L} select account, period, count(*) filter (cents // 1000 = 0) as zero_rows, count(*) filter (cents // 1000 <> 0) as kept_rows from l group by all")
def zero_rows_skipped(spark, sf):
    """Amounts in tens, cut: those of zero are no transactions and are counted."""
    why = rows.breach(F.floor(F.col("cents") / 1000), F.to_date("ts"), F.col("side"))
    return ledger(spark, sf).groupBy(*KEYS).agg(F.count_if(F.coalesce(why == "zero", F.lit(False))).alias("zero_rows"), F.count_if(why.isNull()).alias("kept_rows"))


@query("""select o_orderkey as id, case when o_totalprice is null or round(o_totalprice * 100) < 0 then 'amount' when round(o_totalprice * 100) = 0 then 'zero' when o_orderkey % 89 = 0 then 'date' when o_orderkey % 97 = 0 then 'side' end as reason
from orders where o_totalprice is null or round(o_totalprice * 100) <= 0 or o_orderkey % 89 = 0 or o_orderkey % 97 = 0""")
def contract_quarantine(spark, sf):
    """Rows that break the output's contract, with the first reason."""
    key = F.col("o_orderkey")
    why = rows.breach(money.cents(F.col("o_totalprice")), F.when(key % 89 != 0, F.col("o_orderdate")), F.when(key % 97 == 0, "sideways").otherwise("deposit"))
    return table(spark, sf, "orders").select(key.alias("id"), why.alias("reason")).where("reason is not null")


@query(f"with {L} select account, event_id, cast(ts as date) not between period + 1 and period + 5 as out_of_period from l")
def out_of_period(spark, sf):
    return ledger(spark, sf).select("account", "event_id", rows.outside(F.to_date("ts"), F.date_add("period", 1), F.date_add("period", 5)).alias("out_of_period"))


@query(f"""with {L}, {P}, w as (select account, period, abs(sum(case side when 'deposit' then cents else -cents end))::bigint as amount from p group by all)
select account, period, amount from w where exists (select 1 from l where l.account = w.account and l.cents = w.amount)""")
def amount_semi(spark, sf):
    full = ledger(spark, sf)
    want = parsed(full).groupBy(*KEYS).agg(F.abs(F.sum(rows.signed())).alias("amount"))
    return diagnose.amount_held(want, full, ["account"])


@query(f"""with {L}, {P} select account, period, event_id, cents from l where not exists (select 1 from p where p.account = l.account and p.period = l.period and p.cents = l.cents)""")
def amount_anti(spark, sf):
    full = ledger(spark, sf)
    return diagnose.unread(full, parsed(full), KEYS).select(*KEYS, "event_id", "cents")


# ------------------------------------------------------------------ star tables
@query("""with d as (select l_orderkey, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents, count(*) as n from lineitem group by 1)
select o_orderkey, cast(round(o_totalprice * 100) as bigint) - coalesce(cents, 0) as residual, coalesce(n, 0) as n_rows from orders left join d on l_orderkey = o_orderkey""")
def order_tieout(spark, sf):
    """Header total against detail lines, one residual an order."""
    detail = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(money.cents(F.col("l_extendedprice"))).alias("cents"), F.count(F.lit(1)).alias("n"))
    both = table(spark, sf, "orders").join(detail, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.select("o_orderkey", (money.cents(F.col("o_totalprice")) - F.coalesce("cents", F.lit(0))).alias("residual"), F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def orders_without_rows(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_lines(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ------------------------------------------------------------------ functions
_RENDER = """case o_orderkey % 8 when 0 then a when 1 then '$' || a when 2 then '-' || a when 3 then '(' || a || ')' when 4 then a || '-' when 5 then a || ' CR' when 6 then a || ' DR' else '(' || a end"""


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    cents = money.cents(F.col("o_totalprice"))
    body = F.concat((F.floor(cents / 100)).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    shape = F.expr("o_orderkey % 8")
    signs = [body, F.concat(F.lit("$"), body), F.concat(F.lit("-"), body), F.concat(F.lit("("), body, F.lit(")")), F.concat(body, F.lit("-")), F.concat(body, F.lit(" CR")), F.concat(body, F.lit(" DR"))]
    text_ = F.when(shape == 0, signs[0])
    for i, s in enumerate(signs[1:], 1):
        text_ = text_.when(shape == i, s)
    return table(spark, sf, "orders").select("o_orderkey", cents.alias("cents"), text_.otherwise(F.concat(F.lit("("), body)).alias("text"))


@query(f"""with b as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as c from orders),
r as (select o_orderkey, c, (c // 100) || '.' || lpad((c % 100)::varchar, 2, '0') as a from b),
t as (select o_orderkey, c, {_RENDER} as text from r)
select o_orderkey, text, case o_orderkey % 8 when 7 then null when 2 then -c when 3 then -c when 4 then -c when 6 then -c else c end as cents from t""")
def money_parse(spark, sf):
    return _rendered(spark, sf).select("o_orderkey", "text", money.parse_money(F.col("text")).alias("cents"))


@query("""with b as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as c from orders)
select o_orderkey, case o_orderkey % 8 when 7 then '' when 2 then (-c)::varchar when 3 then (-c)::varchar when 4 then (-c)::varchar when 6 then (-c)::varchar else c::varchar end as cents from b""")
def money_spans(spark, sf):
    """Amounts in running text; dates, longer numbers and parts of words are none."""
    line = F.concat(F.lit("on 01/02/2025 ref 12.345 paid "), "text", F.lit(" and x1.23 left"))
    return _rendered(spark, sf).select("o_orderkey", F.array_join(F.transform(money.find_money(line), lambda x: x["cents"].cast("string")), ",").alias("cents"))


@query("""with b as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as c, (o_orderkey % 6)::int as k from orders)
select o_orderkey, case k when 3 then c when 4 then null when 5 then null else -c end as cents, case k when 3 then c when 4 then null when 5 then null else -c end as found from b""")
def money_marks(spark, sf):
    """Marks on both sides of an amount, in text that is one and in running text."""
    cents = money.cents(F.col("o_totalprice"))
    body = F.concat(F.format_number(F.floor(cents / 100).cast("bigint"), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    k = F.expr("o_orderkey % 6")
    shown = F.when(k == 0, F.concat(F.lit("("), body, F.lit(") CR"))).when(k == 1, F.concat(F.lit("(-"), body, F.lit(")"))).when(k == 2, F.concat(body, F.lit(" CR-"))).when(k == 3, F.concat(body, F.lit("CR"))).when(k == 4, F.concat(body, F.lit(")"))).otherwise(F.concat(body, F.lit("7")))
    found = F.get(money.find_money(F.concat(F.lit("of "), shown)), 0)["cents"]
    return table(spark, sf, "orders").select("o_orderkey", money.parse_money(shown).alias("cents"), found.alias("found"))


@query("""select o_orderkey, cast(o_orderdate as date) as date from orders""")
def date_parse(spark, sf):
    day = F.col("o_orderdate").cast("timestamp")
    formats = ["MM/dd/yyyy", "yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy", "M-d-yyyy"]
    shown = None
    for i, f in enumerate(formats):
        value = F.date_format(day, f)
        hit = F.col("o_orderkey") % len(formats) == i
        shown = F.when(hit, value) if shown is None else shown.when(hit, value)
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_date(shown).alias("date"))


@query("""select c_custkey, right(lpad(c_custkey::varchar, 4, '0'), 4) as last4, case when c_custkey % 3 = 2 then null else right(lpad(c_custkey::varchar, 4, '0'), 4) end as found from customer""")
def masked_account(spark, sf):
    """Account numbers, masked in two ways and hidden in a word in a third."""
    four = F.right(F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit(4))
    kind = F.col("c_custkey") % 3
    line = F.when(kind == 0, F.concat(F.lit("Account XXXX"), four)).when(kind == 1, F.concat(F.lit("no. ****-"), four)).otherwise(F.concat(F.lit("maxXX"), four))
    return table(spark, sf, "customer").select("c_custkey", four.alias("last4"), text.last4(line).alias("found"))


@query("""select o_orderkey, o_orderpriority not in ('5-LOW') and o_orderstatus in ('F', 'O') as beginning, o_orderpriority <> '5-LOW' and o_orderstatus = 'P' as deposits from orders""")
def label_hits(spark, sf):
    """Lines put together of an order's own words and amount: what they name."""
    c = F.col
    amount = money.format_cents(money.cents(c("o_totalprice")))
    word = F.when(c("o_orderpriority") == "5-LOW", "FROMDEPOSITSYSTEM").when(c("o_orderstatus") == "F", "Beginning Balance").when(c("o_orderstatus") == "O", "your OPENINGBALANCE").otherwise("Total  deposits")
    line = F.concat_ws(" ", F.substring("o_orderpriority", 3, 20), word, amount)
    return table(spark, sf, "orders").select("o_orderkey", text.has_label(line, "beginning").alias("beginning"), text.has_label(line, "deposits").alias("deposits"))


# ------------------------------------------------------------------ text and geometry
@query(r"select doc_id, (unnest(range(len(w))))::int as seq, unnest(w) as word from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents)")
def doc_words(spark, sf):
    split = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(split).alias("seq", "word"))


@query("select sha256(regexp_replace(text, '[0-9]', '0', 'g')) as fingerprint, count(*) as n, min(doc_id) as first from documents group by 1")
def template_fingerprint(spark, sf):
    print_ = F.sha2(F.regexp_replace("text", "[0-9]", "0"), 256)
    return table(spark, sf, "documents").groupBy(print_.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def _geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents set in lines of eight, six points a character."""
    split = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    each = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(split).alias("seq", "text"))
    w = Window.partitionBy("page", F.floor(F.col("seq") / 8)).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    x0 = F.coalesce(F.sum(F.length("text") * 6.0 + 4.0).over(w), F.lit(0.0))
    top = F.floor(F.col("seq") / 8) * 12.0 + 100.0
    return each.select("page", "seq", "text", x0.alias("x0"), (x0 + F.length("text") * 6.0).alias("x1"), top.cast("double").alias("top"), F.lit(10.0).alias("height"))


_GEO = r"""w as (select doc_id as page, (unnest(range(len(w))))::int as seq, unnest(w) as text from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents)),
g as (select page, seq, text, coalesce(sum(length(text) * 6.0::double + 4.0::double) over (partition by page, seq // 8 order by seq rows between unbounded preceding and 1 preceding), 0.0)::double as x0, ((seq // 8) * 12.0 + 100.0)::double as top from w)"""


@query(f"with {_GEO} select page, seq, x0, x0 + length(text) * 6.0::double as x1, top from g")
def doc_geometry(spark, sf):
    return _geometry(spark, sf).select("page", "seq", "x0", "x1", "top")


@query(f"with {_GEO} select page, (seq // 8)::int as line_idx, string_agg(text, ' ' order by seq) as text, count(*)::int as n from g group by page, seq // 8")
def line_fold(spark, sf):
    wobble = _geometry(spark, sf).withColumn("top", F.col("top") + (F.col("seq") % 3) * 1.0)
    return geometry.lines(wobble, ["page"]).select("page", "line_idx", "text", F.size("words").alias("n"))


@query(f"""with {L}, d as (select account, cents / 100.0::double as v from l), x as (select account, v, case when v - lag(v) over (partition by account order by v) > 20 then 1 else 0 end as o from d),
y as (select account, v, sum(o) over (partition by account order by v) as cluster from x)
select account, cluster::bigint as cluster, min(v) as lo, max(v) as hi, count(*) as n from y group by 1, 2""")
def money_clusters(spark, sf):
    """An account's amounts as places on one line, cut at gaps over twenty."""
    places = geometry.gap_clusters(ledger(spark, sf).select("account", (F.col("cents") / 100).alias("v")), ["account"], "v")
    return places.groupBy("account", "cluster").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))


@query(f"""with {L}, b as (select account, trunc(cents / 100.0::double - (event_id % 100) * 0.25::double)::bigint as bin, count(*) as n from l group by 1, 2) select account, sum(n * n)::bigint as sharpness from b group by 1""")
def skew_sharpness(spark, sf):
    words = ledger(spark, sf).select("account", (F.col("cents") / 100).alias("top"), (F.col("event_id") % 100).cast("double").alias("x0"))
    return geometry.sharpness(words, ["account"], F.array(F.lit(0.25))).select("account", "sharpness")


_SLOPES = "(values (-0.5::double), (-0.25::double), (0.0::double), (0.25::double), (0.5::double)) s(slope)"


@query(f"""with {L}, b as (select account, slope, trunc(cents / 100.0::double - (event_id % 100) * slope)::bigint as bin, count(*) as n from l, {_SLOPES} group by all),
s as (select account, slope, sum(n * n) as q from b group by all),
t as (select account, max(q) as best, max(q) filter (slope = 0) as square from s group by 1),
m as (select s.account, min(slope) as slope from s join t on s.account = t.account and q = best group by 1)
select account, case when best > square * 1.05::double then slope else 0.0 end::double as slope from t join m using (account)""")
def skew_slope(spark, sf):
    words = ledger(spark, sf).select("account", (F.col("cents") / 100).alias("top"), (F.col("event_id") % 100).cast("double").alias("x0"))
    return geometry.best_slope(geometry.sharpness(words, ["account"], F.array(*map(F.lit, (-0.5, -0.25, 0.0, 0.25, 0.5)))), ["account"])


@query(f"""with {L}, m as (select account % 10 as doc, account as page, median(cents / 100.0::double) as margin, count(*) as n from l group by 1, 2 having count(*) >= 3),
t as (select doc, median(margin) as target from m group by 1 having count(*) >= 2)
select doc, page, margin, case when abs(target - margin) <= 30 then target - margin end as shift from m join t using (doc)""")
def registration_shift(spark, sf):
    places = ledger(spark, sf).select((F.col("account") % 10).alias("doc"), F.col("account").alias("page"), (F.col("cents") / 100).alias("left"))
    return geometry.page_shifts(places, "doc", "page", "left")


@query(f"with {L} select account, median(cents / 100.0::double) as margin, count(*) as n from l group by 1 having count(*) >= 3")
def row_margin(spark, sf):
    return geometry.row_margins(ledger(spark, sf).select("account", (F.col("cents") / 100).alias("left")), ["account"], "left")


@query(f"with {_GEO} select page, seq, x0 + top * 0.0625::double as x0, top - x0 * 0.0625::double as top from g")
def deskew(spark, sf):
    return geometry.deskew(_geometry(spark, sf), F.lit(0.0625)).select("page", "seq", "x0", "top")


@query("""with d as (select source, doc_id, length(text) as n, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[.]$'))) as rows from documents),
r as (select *, row_number() over (partition by source order by rows desc, doc_id) as k from d) select source, doc_id, rows::int as rows, k::int as k from r where k <= 3""")
def densest_pages(spark, sf):
    found = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[.]$")))
    return rows.top_ranked(table(spark, sf, "documents").select("source", "doc_id", found.alias("rows")), ["source"], "rows", "doc_id", 3)


@query(r"""with d as (select source, doc_id, case doc_id % 5 when 0 then 'Opening balance 1,000.00 of ' || doc_id || '.00 ' else '' end || text as text from documents)
select source, count(*) as pages, sum(length(text))::bigint as chars, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::bigint as words, count(*) filter (length(trim(text)) < 20) as empty_pages,
  coalesce(string_agg(doc_id::varchar, ',' order by doc_id) filter (doc_id % 5 = 0), '') as anchor_pages,
  sum(len(list_filter(regexp_extract_all(' ' || regexp_replace(text, '([0-9.,]) ', '\1  ', 'g') || ' ', '(?:^|[^\p{L}\p{N}_.,])([(]?-?[$]?(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)[.][0-9]{2}[)]?)(?:[^0-9]|$)', 1), lambda m: contains(m, '(') = contains(m, ')'))))::bigint as amounts
  from d group by 1""")
def doc_diagnostics(spark, sf):
    """Pages of documents by source, some with an opening balance set before them."""
    lead = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Opening balance 1,000.00 of "), F.col("doc_id").cast("string"), F.lit(".00 "))).otherwise("")
    pages = table(spark, sf, "documents").select("source", F.col("doc_id").alias("page"), F.concat(lead, "text").alias("text"))
    found = edges.diagnostics(pages, ["source"])
    return found.withColumn("anchor_pages", F.array_join("anchor_pages", ","))


@query(f"with {L} select cast(date_trunc('week', ts) as date) as period, side, count(*) as n, sum(cents)::bigint as cents from l group by 1, 2")
def weekly_tieout_stream(spark, sf):
    """Running sums over the events as a stream of files, drained."""
    return tieout.weekly(spark, sf)


@query(f"""with {L}, {F0}, r as (select * from l where event_id % 83 <> 4 and (account % 20 <> 3 or period <> date '2024-01-08')),
t as (select account, period, coalesce(sum(cents) filter (side = 'deposit'), 0)::bigint as dep_cents, coalesce(sum(cents) filter (side = 'withdrawal'), 0)::bigint as wd_cents,
         count(*) filter (side = 'deposit') as dep_n, count(*) filter (side = 'withdrawal') as wd_n from r group by all)
select account, period, coalesce(dep_n, 0) + coalesce(wd_n, 0) as n_rows, (beginning + coalesce(dep_cents, 0) - coalesce(wd_cents, 0) - ending)::bigint as residual,
  coalesce(dep_cents, 0) = deposits_total and coalesce(wd_cents, 0) = withdrawals_total and coalesce(dep_n, 0) = deposits_count and coalesce(wd_n, 0) = withdrawals_count as reconciled
from f1 left join t using (account, period) where period + interval 7 days <= (select max(ts) - interval 1 day from l)""")
def weekly_checks_stream(spark, sf):
    """Printed figures and rows as two streams, joined as their weeks close; of some
    weeks rows are missing, of some all."""
    rows_ = tieout.event_rows(spark, sf).where("event_id % 83 <> 4 and (account % 20 <> 3 or to_date(date_trunc('week', ts)) <> date'2024-01-08')")
    found = tieout.closed_weeks(spark, printed(ledger(spark, sf), hide=False), rows_)
    return found.select("account", "period", (F.col("dep_n") + F.col("wd_n")).alias("n_rows"), "residual", "reconciled")
