"""Composite jobs on the supplied tables, read as credit data: customers apply, orders are earlier loans and
applications, line items are their monthly rows and payments. The renaming expressions are plain SQL that both
engines read."""

from pyspark.sql import functions as F

from featforge.operators import synthesis as D
from featforge.plans import credit
from featforge.plans.keys import NUDGE, ORACLE, key, rounded, table
from featforge.plans.keys import synthesis as S
from featforge.plans.workflows import build_feature_set
from featforge.plans.workflows import single_table_features as single_table
from featforge.session import scratch_path
from featforge.sources.store import FeatureStore

_ACTIVE = "case o_orderstatus when 'F' then 'Closed' when 'O' then 'Active' else 'Sold' end"
_CONTRACT = "case o_orderstatus when 'F' then 'Approved' when 'O' then 'Refused' end"
_APPLICATION = {
    "SK_ID_CURR": "c_custkey",
    "TARGET": "case when c_acctbal < 0 then 1 else 0 end",
    "CODE_GENDER": "case c_mktsegment when 'MACHINERY' then 'XNA' when 'BUILDING' then 'M' when 'FURNITURE' then null else 'F' end",
    "FLAG_OWN_CAR": "case when c_nationkey % 2 = 0 then 'Y' else 'N' end",
    "FLAG_OWN_REALTY": "case when c_nationkey % 3 = 0 then 'Y' else 'N' end",
    "NAME_SEGMENT": "case when c_mktsegment = 'FURNITURE' then null else c_mktsegment end",
    "AMT_INCOME_TOTAL": "abs(c_acctbal) + 1000", "AMT_CREDIT": "abs(c_acctbal) * 3", "AMT_ANNUITY": "nullif(abs(c_acctbal) / 4, 0)",
    "AMT_GOODS_PRICE": "abs(c_acctbal) * 2 + 7", "CNT_FAM_MEMBERS": "cast(c_nationkey % 5 as double)",
    "DAYS_BIRTH": "cast(-7000 - c_custkey % 15000 as int)",
    "DAYS_EMPLOYED": "cast(case when c_nationkey = 3 then 365243 else -1 - c_custkey % 4000 end as int)",
    "EXT_SOURCE_1": "nullif(cast(c_custkey % 8 as double) / 8, 0)", "EXT_SOURCE_2": "nullif(cast(c_custkey % 4 as double) / 4, 0)",
    "EXT_SOURCE_3": "nullif(cast(c_nationkey % 16 as double) / 16, 0)",
}
_BUREAU = {
    "SK_ID_CURR": "o_custkey", "SK_ID_BUREAU": "o_orderkey", "CREDIT_ACTIVE": _ACTIVE, "CREDIT_CURRENCY": "substr(o_orderpriority, 1, 1)",
    "CREDIT_TYPE": "nullif(o_orderpriority, '5-LOW')", "DAYS_CREDIT": "cast(-(o_orderkey % 2900) as int)",
    "CREDIT_DAY_OVERDUE": "cast(o_orderkey % 3 as int)", "DAYS_CREDIT_ENDDATE": "nullif(cast(o_orderkey % 800 as double) - 400, 0)",
    "AMT_CREDIT_MAX_OVERDUE": "nullif(cast(o_orderkey % 50 as double), 0)", "CNT_CREDIT_PROLONG": "cast(o_orderkey % 4 as int)",
    "AMT_CREDIT_SUM": "o_totalprice", "AMT_CREDIT_SUM_DEBT": "nullif(cast(o_orderkey % 977 as double), 0)",
    "AMT_CREDIT_SUM_LIMIT": "cast(o_orderkey % 100 as double)", "AMT_CREDIT_SUM_OVERDUE": "cast(o_orderkey % 10 as double)",
    "DAYS_CREDIT_UPDATE": "cast(-(o_orderkey % 60) as int)", "AMT_ANNUITY": "nullif(cast(o_orderkey % 120 as double), 0)",
}
_BALANCE = {"SK_ID_BUREAU": "l_orderkey", "MONTHS_BALANCE": "-l_linenumber", "STATUS": "nullif(l_returnflag, 'R')"}
_PREVIOUS = {
    "SK_ID_PREV": "o_orderkey", "SK_ID_CURR": "o_custkey", "NAME_CONTRACT_STATUS": _CONTRACT,
    "PRODUCT_COMBINATION": "nullif(o_orderpriority, '2-HIGH')", "AMT_ANNUITY": "nullif(cast(o_orderkey % 91 as double), 0)",
    "AMT_APPLICATION": "cast(o_orderkey % 500 as double)", "AMT_CREDIT": "cast(o_orderkey % 400 as double)",
    "AMT_DOWN_PAYMENT": "cast(o_orderkey % 77 as double)", "AMT_GOODS_PRICE": "cast(o_orderkey % 1000 as double)",
    "HOUR_APPR_PROCESS_START": "cast(o_orderkey % 24 as int)", "RATE_DOWN_PAYMENT": "cast(o_orderkey % 32 as double) / 32",
    "DAYS_DECISION": "cast(-(o_orderkey % 1000) as int)", "CNT_PAYMENT": "cast(o_orderkey % 60 as double)",
    "DAYS_FIRST_DUE": "cast(case when o_orderkey % 9 = 0 then 365243 else -(o_orderkey % 700) end as double)",
}
_POS = {"SK_ID_PREV": "l_orderkey", "SK_ID_CURR": "o_custkey", "MONTHS_BALANCE": "-l_linenumber",
        "NAME_CONTRACT_STATUS": "l_linestatus", "SK_DPD": "cast(l_quantity as int)", "SK_DPD_DEF": "l_linenumber"}
_INSTALLMENTS = {
    "SK_ID_PREV": "l_orderkey", "SK_ID_CURR": "o_custkey", "NUM_INSTALMENT_VERSION": "cast(l_linenumber as double)",
    "DAYS_INSTALMENT": "cast(-(l_partkey % 1400) as double)", "DAYS_ENTRY_PAYMENT": "cast(nullif(-(l_partkey % 1400) + l_suppkey % 21 - 10, -100) as double)",
    "AMT_INSTALMENT": "l_quantity - 1", "AMT_PAYMENT": "nullif(l_quantity, 30) + l_linenumber - 4",
}
_CARD = {"SK_ID_PREV": "l_orderkey", "SK_ID_CURR": "o_custkey", "MONTHS_BALANCE": "-l_linenumber",
         "NAME_CONTRACT_STATUS": "nullif(l_returnflag, 'N')", "AMT_BALANCE": "l_quantity * 8", "CNT_DRAWINGS": "nullif(l_linenumber, 3)"}
_SOURCES = {
    "bureau": ("orders", _BUREAU), "bureau_balance": ("lineitem", _BALANCE), "previous_application": ("orders", _PREVIOUS),
    "pos_cash_balance": ("lines", _POS), "installments_payments": ("lines", _INSTALLMENTS), "credit_card_balance": ("lines", _CARD),
}
_JOINED = "(select * from lineitem join orders on l_orderkey = o_orderkey)"


def _expressions(columns, skip=()):
    return [f"{e} as {n}" for n, e in columns.items() if n not in skip]


def credit_tables(spark, sf_dir):
    customer, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    sources = {"orders": orders, "lineitem": lines, "lines": lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])}
    out = {name: sources[s].selectExpr(*_expressions(c)) for name, (s, c) in _SOURCES.items()}
    out["application_train"] = customer.where("c_custkey % 5 <> 0").selectExpr(*_expressions(_APPLICATION))
    out["application_test"] = customer.where("c_custkey % 5 = 0").selectExpr(*_expressions(_APPLICATION, ["TARGET"]))
    return out


def _sql_tables():
    parts = [f"app as (select {', '.join(_expressions(_APPLICATION))} from customer)"]
    for name, (s, c) in _SOURCES.items():
        parts.append(f"{name} as (select {', '.join(_expressions(c))} from {_JOINED if s == 'lines' else s})")
    return "with " + ",\n".join(parts)


_WITH = _sql_tables()
_APP_COLUMNS = ", ".join(f"app.{c}" for c in _APPLICATION)


def _applications(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*_expressions(_APPLICATION))


_MANUAL_SQL = f"""{_WITH}
select app.SK_ID_CURR, round(AMT_CREDIT / AMT_INCOME_TOTAL, 9) as credit_income_ratio, round(AMT_ANNUITY / AMT_INCOME_TOTAL, 9) as annuity_income_ratio,
       round(AMT_CREDIT / AMT_ANNUITY, 9) as credit_term, round(DAYS_EMPLOYED / DAYS_BIRTH::double, 9) as days_employed_ratio,
       ((EXT_SOURCE_1 is null)::int + (EXT_SOURCE_2 is null)::int + (EXT_SOURCE_3 is null)::int)::int as ext_sources_nan,
       nullif(active, 0)::bigint as active_loans_count, nullif(closed, 0)::bigint as closed_loans_count,
       round(duration, 9) as avg_credit_duration, n_prev::bigint as previous_application_count,
       round(approved, 9) as previous_approval_ratio, round(late, 9) as late_payment_ratio, round(paid, 9) as avg_payment_installment_ratio
from app
left join (select SK_ID_CURR, count_if(CREDIT_ACTIVE = 'Active') as active, count_if(CREDIT_ACTIVE = 'Closed') as closed,
                  avg(DAYS_CREDIT - DAYS_CREDIT_ENDDATE) as duration from bureau group by 1) b using (SK_ID_CURR)
left join (select SK_ID_CURR, count(*) as n_prev, nullif(count_if(NAME_CONTRACT_STATUS = 'Approved'), 0) / count(*)::double as approved
           from previous_application group by 1) p using (SK_ID_CURR)
left join (select SK_ID_CURR, avg(coalesce(DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT, false)::int) as late,
                  avg(AMT_PAYMENT / nullif(AMT_INSTALMENT, 0)) as paid from installments_payments group by 1) i using (SK_ID_CURR)"""


@key("manual_features", _MANUAL_SQL)
def manual_features(spark, sf_dir):
    t, app = credit_tables(spark, sf_dir), _applications(spark, sf_dir)
    out = credit.manual_features(app, t["bureau"], t["previous_application"], t["installments_payments"])
    return rounded(out.drop(*[c for c in app.columns if c != credit.KEY]), 9)


@key("manual_features_p1", f"""{_WITH}
select app.SK_ID_CURR, round(debt, 9) as debt_credit_ratio_None, product as "prev_PRODUCT_COMBINATION", round(days, 9) as DAYS_CREDIT_mean,
       last_active as last_active_DAYS_CREDIT, round(gap, 9) as installment_payment_ratio_1000_mean_mean,
       round(AMT_CREDIT / nullif(AMT_ANNUITY, 0), 9) as credit_annuity_ratio, round(AMT_CREDIT / AMT_GOODS_PRICE, 9) as credit_goods_price_ratio,
       round(AMT_GOODS_PRICE - AMT_CREDIT, 6) as credit_downpayment, trunc(DAYS_BIRTH / -365.0::double)::int as AGE_INT,
       round(AMT_ANNUITY / nullif(largest, 0), 9) as annuity_to_max_installment_ratio,
       round((coalesce(EXT_SOURCE_1, 0) + coalesce(EXT_SOURCE_2, 0) + coalesce(EXT_SOURCE_3, 0)) / nullif((EXT_SOURCE_1 is not null)::int
             + (EXT_SOURCE_2 is not null)::int + (EXT_SOURCE_3 is not null)::int, 0), 9) as EXT_SOURCES_MEAN,
       greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) as EXT_SOURCES_MAX
from app
left join (select SK_ID_CURR, sum(AMT_CREDIT_SUM_DEBT) / nullif(sum(AMT_CREDIT_SUM), 0) as debt, avg(DAYS_CREDIT) as days,
                  max(DAYS_CREDIT) filter (CREDIT_ACTIVE = 'Active') as last_active from bureau group by 1) b using (SK_ID_CURR)
left join (select SK_ID_CURR, arg_max(PRODUCT_COMBINATION, (DAYS_DECISION, SK_ID_PREV)) filter (PRODUCT_COMBINATION is not null) as product
           from previous_application group by 1) p using (SK_ID_CURR)
left join (select SK_ID_CURR, avg(m) as gap from (select SK_ID_CURR, SK_ID_PREV, avg(AMT_PAYMENT - AMT_INSTALMENT) as m
           from installments_payments where DAYS_INSTALMENT > -1000 group by 1, 2) group by 1) g using (SK_ID_CURR)
left join (select SK_ID_CURR, max(AMT_INSTALMENT) as largest from installments_payments group by 1) m using (SK_ID_CURR)""")
def manual_features_p1(spark, sf_dir):
    t, app = credit_tables(spark, sf_dir), _applications(spark, sf_dir)
    out = credit.manual_features_p1(app, t["bureau"], t["previous_application"], t["installments_payments"])
    return rounded(rounded(out.drop(*[c for c in app.columns if c != credit.KEY]), {"credit_downpayment": 6}), 9)


_FN_SQL = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "sum": "coalesce(sum({c}), 0)", "var": "var_samp({c})",
           "size": "count(*)", "nunique": "count(distinct {c})"}
_KINDS = {  # fixed values: categories of the renamed columns
    "CREDIT_ACTIVE": ["Active", "Closed", "Sold"], "CREDIT_CURRENCY": list("12345"),
    "CREDIT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "NAME_CONTRACT_STATUS": ["Approved", "Refused"],
    "PRODUCT_COMBINATION": ["1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "NAME_SEGMENT": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"],
}


def _spec_sql(spec, prefix):
    return [f'{_FN_SQL[f].format(c=c)}::double as "{prefix}{c}_{f.upper()}"' for c, fns in spec.items() for f in fns]


def _hot(column, values, nan=True, name=None):
    name = column if name is None else name
    out = [(f"{name}_{v}" if name else v, f"({column} is not distinct from '{v}')::int") for v in values]
    return out + ([(f"{name}_nan", f"({column} is null)::int")] if nan else [])


def _means(pairs, prefix="", suffix="_MEAN"):
    return [f'avg({e})::double as "{prefix}{n}{suffix}"' for n, e in pairs]


def _clean_sql():
    months = _hot("STATUS", ["A", "N"])
    kinds = [p for c in ("CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE") for p in _hot(c, _KINDS[c])]
    previous = [p for c in ("NAME_CONTRACT_STATUS", "PRODUCT_COMBINATION") for p in _hot(c, _KINDS[c])]
    pos, card = _hot("NAME_CONTRACT_STATUS", ["F", "O"]), _hot("NAME_CONTRACT_STATUS", ["A", "R"])
    loans = (f"(select bureau.*, m.* exclude (SK_ID_BUREAU) from bureau left join (select SK_ID_BUREAU, "
             + ", ".join(_spec_sql(credit.BALANCE_SPEC, "") + _means(months)) + " from bureau_balance group by 1) m using (SK_ID_BUREAU))")
    prevs = "(select *, AMT_APPLICATION / nullif(AMT_CREDIT, 0) as APP_CREDIT_PERC from previous_application)"
    pays = ("(select *, AMT_PAYMENT / nullif(AMT_INSTALMENT, 0) as PAYMENT_PERC, AMT_INSTALMENT - AMT_PAYMENT as PAYMENT_DIFF, "
            "greatest(coalesce(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0), 0) as DPD, greatest(coalesce(DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT, 0), 0) as DBD "
            "from installments_payments)")
    cards = "(select SK_ID_CURR, MONTHS_BALANCE, AMT_BALANCE, CNT_DRAWINGS, " + ", ".join(f'{e} as "{n}"' for n, e in card) + " from credit_card_balance)"
    card_spec = {f'{c}': credit.CARD_FUNCTIONS for c in ["MONTHS_BALANCE", "AMT_BALANCE", "CNT_DRAWINGS", *[n for n, _ in card]]}
    grouped = lambda cols, source, where="": f"(select SK_ID_CURR, {', '.join(cols)} from {source} {where} group by 1)"
    parts = [
        grouped(_spec_sql(credit.BUREAU_SPEC, "BURO_") + _means(kinds, "BURO_")
                + [f'avg("{n}_MEAN")::double as "BURO_{n}_MEAN_MEAN"' for n, _ in months], loans),
        grouped(_spec_sql(credit.BUREAU_SPEC, "ACTIVE_"), loans, "where CREDIT_ACTIVE = 'Active'"),
        grouped(_spec_sql(credit.BUREAU_SPEC, "CLOSED_"), loans, "where CREDIT_ACTIVE = 'Closed'"),
        grouped(_spec_sql(credit.PREVIOUS_SPEC, "PREV_") + _means(previous, "PREV_"), prevs),
        grouped(_spec_sql(credit.PREVIOUS_SPEC, "APPROVED_"), prevs, "where NAME_CONTRACT_STATUS = 'Approved'"),
        grouped(_spec_sql(credit.PREVIOUS_SPEC, "REFUSED_"), prevs, "where NAME_CONTRACT_STATUS = 'Refused'"),
        grouped(_spec_sql(credit.POS_SPEC, "POS_") + _means(pos, "POS_") + ['count(*)::double as "POS_COUNT"'], "pos_cash_balance"),
        grouped(_spec_sql(credit.INSTALLMENT_SPEC, "INSTAL_") + ['count(*)::double as "INSTAL_COUNT"'], pays),
        grouped(_spec_sql(card_spec, "CC_") + ['count(*)::double as "CC_COUNT"'], cards),
    ]
    codes = ", ".join(f"coalesce((select code from (select {c} as v, row_number() over (order by min(SK_ID_CURR)) - 1 as code from kept "
                      f"where {c} is not null group by 1) where v = kept.{c}), -1)::double as {c}" for c in credit.BINARY)
    plain = [c for c in _APPLICATION if c not in (*credit.BINARY, "NAME_SEGMENT", "TARGET", "DAYS_EMPLOYED", "SK_ID_CURR")]
    root = (f"kept as (select * from app where CODE_GENDER is distinct from 'XNA'), root as (select SK_ID_CURR, {codes}, "
            "(case when SK_ID_CURR % 5 <> 0 then TARGET end)::double as TARGET, nullif(DAYS_EMPLOYED, 365243)::double as DAYS_EMPLOYED, "
            + ", ".join(f"{c}::double as {c}" for c in plain) + ", "
            + ", ".join(f'{e}::double as "{n}"' for n, e in _hot("NAME_SEGMENT", _KINDS["NAME_SEGMENT"], nan=False))
            + ", nullif(DAYS_EMPLOYED, 365243) / DAYS_BIRTH::double as DAYS_EMPLOYED_PERC, AMT_INCOME_TOTAL / nullif(AMT_CREDIT, 0) as INCOME_CREDIT_PERC, "
            "AMT_INCOME_TOTAL / nullif(CNT_FAM_MEMBERS, 0) as INCOME_PER_PERSON, AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) as ANNUITY_INCOME_PERC, "
            "AMT_ANNUITY / nullif(AMT_CREDIT, 0) as PAYMENT_RATE from kept)")
    body = " ".join(f"left join {p} t{i} using (SK_ID_CURR)" for i, p in enumerate(parts))
    return f"{_WITH}, {root}, m as (select * from root {body}) select SK_ID_CURR, round(columns(* exclude (SK_ID_CURR)) * {NUDGE}, 3) from m"


def _all_doubles(df, digits=3):
    """Every column but the key as a rounded double, so that one rule covers a wide matrix on both sides."""
    return rounded(df.selectExpr(credit.KEY, *[f"cast(`{c}` as double) as `{c}`" for c in df.columns if c != credit.KEY]),
                   digits, nudge=True)


@key("clean_and_aggregate", _clean_sql())
def clean_and_aggregate(spark, sf_dir):
    return _all_doubles(credit.clean_and_aggregate(credit_tables(spark, sf_dir)))


def _average_sql():
    avg = lambda cols, prefix="": [f'avg({c})::double as "{prefix}{c}"' for c in cols]
    text = {"CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE", "NAME_CONTRACT_STATUS", "PRODUCT_COMBINATION"}
    numbers = lambda columns, skip: [c for c in columns if c not in text and c not in skip]
    months = _hot("STATUS", ["A", "N"], nan=False, name="buro_bal_status")
    per_loan = ("select SK_ID_BUREAU, avg(MONTHS_BALANCE) as \"avg_buro_MONTHS_BALANCE\", " + ", ".join(_means(months, "avg_buro_", ""))
                + ", count(MONTHS_BALANCE)::double as avg_buro_buro_count from bureau_balance group by 1")
    monthly = ["avg_buro_MONTHS_BALANCE", *[f"avg_buro_{n}" for n, _ in months], "avg_buro_buro_count"]
    kinds = [p for c, n in (("CREDIT_ACTIVE", "ca_"), ("CREDIT_CURRENCY", "cu_"), ("CREDIT_TYPE", "ty_")) for p in _hot(c, _KINDS[c], False, n)]
    previous = [p for c in ("NAME_CONTRACT_STATUS", "PRODUCT_COMBINATION") for p in _hot(c, _KINDS[c], False)]
    grouped = lambda cols, source: f"select SK_ID_CURR, {', '.join(cols)} from {source} group by 1"
    n = lambda c, prefix="": f'count({c})::double as "{prefix}{c}"'
    b = grouped([n("SK_ID_BUREAU")] + avg(numbers(_BUREAU, ["SK_ID_CURR", "SK_ID_BUREAU"])) + [f'avg("{c}")::double as "{c}"' for c in monthly]
                + _means(kinds, "", ""), f"bureau left join ({per_loan}) using (SK_ID_BUREAU)")
    ids = ["SK_ID_CURR", "SK_ID_PREV"]
    p = grouped([n("SK_ID_PREV")] + avg(numbers(_PREVIOUS, ids)) + _means(previous, "", ""), "previous_application")
    s = grouped([n("SK_ID_PREV")] + avg(numbers(_POS, ids)) + _means(_hot("NAME_CONTRACT_STATUS", ["F", "O"], False, ""), "", ""), "pos_cash_balance")
    c = grouped([n("SK_ID_PREV", "cc_bal_")] + avg(numbers(_CARD, ids), "cc_bal_")
                + _means(_hot("NAME_CONTRACT_STATUS", ["A", "R"], False, "cc_bal_status_"), "cc_bal_", ""), "credit_card_balance")
    i = grouped([n("SK_ID_PREV", "inst_")] + avg(numbers(_INSTALLMENTS, ids), "inst_"), "installments_payments")
    names = [c for c in _APPLICATION if c != "TARGET"]
    strings = (*credit.BINARY, "NAME_SEGMENT")
    codes = [f"coalesce((select code from (select {x} as v, row_number() over (order by min(SK_ID_CURR)) - 1 as code from app "
             f"where SK_ID_CURR % 5 <> 0 and {x} is not null group by 1) where v = app.{x}), -1)::double as {x}" for x in strings]
    root = ("select SK_ID_CURR, " + ", ".join(codes + [f"{x}::double as {x}" for x in names if x not in (*strings, "SK_ID_CURR")])
            + ", (case when SK_ID_CURR % 5 <> 0 then TARGET end)::double as TARGET from app")
    # Names that clash get _x on the left and _y on the right, join after join.
    return f"""{_WITH}, r as ({root}), b as ({b}), p as ({p}), s as ({s}), c as ({c}), i as ({i}),
m as (select r.* exclude (AMT_ANNUITY, AMT_CREDIT, AMT_GOODS_PRICE), r.AMT_ANNUITY as AMT_ANNUITY_x, b.* exclude (SK_ID_CURR, AMT_ANNUITY),
      b.AMT_ANNUITY as AMT_ANNUITY_y, r.AMT_CREDIT as AMT_CREDIT_x, r.AMT_GOODS_PRICE as AMT_GOODS_PRICE_x,
      p.* exclude (SK_ID_CURR, AMT_CREDIT, AMT_GOODS_PRICE, SK_ID_PREV), p.AMT_CREDIT as AMT_CREDIT_y, p.AMT_GOODS_PRICE as AMT_GOODS_PRICE_y,
      p.SK_ID_PREV as SK_ID_PREV_x, s.SK_ID_PREV as SK_ID_PREV_y, s.* exclude (SK_ID_CURR, SK_ID_PREV), c.* exclude (SK_ID_CURR), i.* exclude (SK_ID_CURR)
      from r left join b using (SK_ID_CURR) left join p using (SK_ID_CURR) left join s using (SK_ID_CURR)
      left join c using (SK_ID_CURR) left join i using (SK_ID_CURR))
select SK_ID_CURR, round(columns(* exclude (SK_ID_CURR)) * {NUDGE}, 3) from m"""


@key("average_everything", _average_sql())
def average_everything(spark, sf_dir):
    train, test = credit.average_everything(credit_tables(spark, sf_dir))
    return _all_doubles(train.unionByName(test, allowMissingColumns=True))


@key("single_table_features", f"""
with f as (select c_custkey, nullif(c_mktsegment, 'MACHINERY') as segment, count(o_orderkey) as n, max(o_totalprice) filter (o_orderstatus = 'P') as v
           from customer left join orders on c_custkey = o_custkey group by 1, 2),
x as (select c_custkey, n, coalesce(v, (select median(v) from f)) as v,
             coalesce(segment, (select segment from f where segment is not null group by 1 order by count(*) desc, 1 limit 1)) as segment from f)
select c_custkey::bigint as c_custkey, segment, n::bigint as n, round(v, 4) as v, (n - lag(n) over w)::bigint as "DIFF(n)",
       round((v - lag(v) over w) * {NUDGE}, 4) as "DIFF(v)", (sum(n) over w)::bigint as "CUM_SUM(n)", round((sum(v) over w) * {NUDGE}, 2) as "CUM_SUM(v)",
       round(avg(n) over w, 9) as "CUM_MEAN(n)", round((avg(v) over w) * {NUDGE}, 4) as "CUM_MEAN(v)",
       round((rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0::double) / count(*) over (), 9) as "PERCENTILE(n)",
       round((rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double) / count(*) over (), 9) as "PERCENTILE(v)",
       round((n + v) / 2 * {NUDGE}, 4) as "ROW_MEAN"
from x window w as (order by c_custkey)""")
def single_table_features(spark, sf_dir):
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("v"))
    df = table(spark, sf_dir, "customer").join(per_customer, "c_custkey", "left").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"), F.coalesce("n", F.lit(0)).alias("n"), "v",
        F.lit(None).cast("double").alias("empty"), "c_name")
    out = single_table(df, "c_custkey", ["n", "v"], drop=["c_name"], mean_of=["n", "v"])
    whole = [f.name for f in out.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int")]
    out = out.withColumns({c: F.col(f"`{c}`").cast("long") for c in whole})
    prices = rounded(out, {"DIFF(v)": 4, "CUM_SUM(v)": 2, "CUM_MEAN(v)": 4, "ROW_MEAN": 4}, nudge=True)
    return rounded(rounded(prices, {"v": 4}), {"CUM_MEAN(n)": 9, "PERCENTILE(n)": 9, "PERCENTILE(v)": 9})


@key("feature_set", "select m.*, d.* exclude (c_custkey, c_acctbal) from (" + _MANUAL_SQL + ") m join ("
     + ORACLE["dfs_depth1"] + ") d on m.SK_ID_CURR = d.c_custkey")
def feature_set(spark, sf_dir):
    """Manual and synthesised features saved as a version of the store and read back."""
    es = D.EntitySet("application")
    es.add("application", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("SK_ID_CURR")), "SK_ID_CURR")
    es.add("orders", table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    es.relate("application", "SK_ID_CURR", "orders", "o_custkey")
    store = FeatureStore(spark, scratch_path(spark, "store"))
    build_feature_set(es, manual_features(spark, sf_dir), "SK_ID_CURR", store, "credit", max_depth=1)
    digits = {c: S._digits(c) for c in store.load("credit").columns if "orders" in c}
    return rounded(store.load("credit"), digits, nudge=True)
