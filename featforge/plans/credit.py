"""Hand-made credit features: a root table of applications and its related tables.

Every child table is read once and rolled up in one aggregate per parent level; the results are left-joined to the
root by the application key. Column names of the sources are those of the public credit-default data set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.functions.aggregates import count_ratio, last_by, mean_ratio, ratio_of_sums, share_true
from featforge.functions.numeric import (col, positive_part, quote, ratio, row_max, row_mean, row_null_count,
                                         to_int_trunc)
from featforge.operators.encode import apply_codes, factorize, factorize_map, fit_one_hot, one_hot
from featforge.operators.joins import assemble, attach, merge_suffix, union_by_name
from featforge.operators.rollup import (agg_columns, category_share_texts, group_agg, group_agg_where, grouped,
                                        group_mean_numeric, mean_of_means)
from featforge.operators.rows import (add_ratios, filter_not_equal, null_sentinel, replace_columns,
                                      sanitize_names, string_columns)

KEY, BUREAU_KEY, PREVIOUS_KEY = "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV"
UNKNOWN_DAYS = 365243  # fixed value: "no date" in the day columns
EXTERNAL = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


# Manual features ---------------------------------------------------------------------------------------------------

def manual_features(app: DataFrame, bureau: DataFrame | None = None, previous: DataFrame | None = None,
                    installments: DataFrame | None = None) -> DataFrame:
    """Ratios of the application plus loan, application and payment history of the same client."""
    # Names and columns of the ratios.
    out = add_ratios(app, {
        "credit_income_ratio": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "annuity_income_ratio": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "credit_term": ("AMT_CREDIT", "AMT_ANNUITY"),
        "days_employed_ratio": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    }).withColumn("ext_sources_nan", row_null_count(EXTERNAL))
    parts = []
    if bureau is not None:
        status = col("CREDIT_ACTIVE")
        parts.append(agg_columns(
            bureau, KEY,
            active_loans_count=F.nullif(F.count_if(status == "Active"), F.lit(0)),
            closed_loans_count=F.nullif(F.count_if(status == "Closed"), F.lit(0)),
            avg_credit_duration=F.avg(col("DAYS_CREDIT") - col("DAYS_CREDIT_ENDDATE"))))
    if previous is not None:
        parts.append(agg_columns(
            previous, KEY, previous_application_count=F.count(F.lit(1)),
            previous_approval_ratio=count_ratio(col("NAME_CONTRACT_STATUS") == "Approved")))
    if installments is not None:
        parts.append(agg_columns(
            installments, KEY, late_payment_ratio=share_true(col("DAYS_ENTRY_PAYMENT") > col("DAYS_INSTALMENT")),
            avg_payment_installment_ratio=mean_ratio("AMT_PAYMENT", "AMT_INSTALMENT")))
    return assemble(out, parts, KEY)


def manual_features_p1(app: DataFrame, bureau: DataFrame, previous: DataFrame, installments: DataFrame) -> DataFrame:
    """The first hand-picked set: debt share, last product, payment gaps, age, external scores."""
    loans = agg_columns(
        bureau, KEY, debt_credit_ratio_None=ratio_of_sums("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
        DAYS_CREDIT_mean=F.avg("DAYS_CREDIT"),
        last_active_DAYS_CREDIT=F.max(F.when(col("CREDIT_ACTIVE") == "Active", col("DAYS_CREDIT"))))
    products = agg_columns(previous, KEY, prev_PRODUCT_COMBINATION=last_by("PRODUCT_COMBINATION", "DAYS_DECISION", PREVIOUS_KEY))
    gaps = mean_of_means(installments.where(col("DAYS_INSTALMENT") > -1000), KEY, PREVIOUS_KEY,
                         col("AMT_PAYMENT") - col("AMT_INSTALMENT"), "installment_payment_ratio_1000_mean_mean")
    largest = agg_columns(installments, KEY, _largest=F.max("AMT_INSTALMENT"))
    out = assemble(app, [loans, products, gaps, largest], KEY)
    return replace_columns(out, {
        "credit_annuity_ratio": ratio("AMT_CREDIT", "AMT_ANNUITY"),
        "credit_goods_price_ratio": ratio("AMT_CREDIT", "AMT_GOODS_PRICE"),
        "credit_downpayment": col("AMT_GOODS_PRICE") - col("AMT_CREDIT"),
        "AGE_INT": to_int_trunc(col("DAYS_BIRTH") / -365),
        "annuity_to_max_installment_ratio": ratio("AMT_ANNUITY", "_largest"),
        "EXT_SOURCES_MEAN": row_mean(EXTERNAL),
        "EXT_SOURCES_MAX": row_max(EXTERNAL),
    }).drop("_largest")


# Clean and aggregate -----------------------------------------------------------------------------------------------

# Which statistics the feature set takes of which column.
BALANCE_SPEC = {"MONTHS_BALANCE": ["min", "max", "size"]}
BUREAU_SPEC = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
PREVIOUS_SPEC = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}
POS_SPEC = {"MONTHS_BALANCE": ["max", "mean", "size"], "SK_DPD": ["max", "mean"], "SK_DPD_DEF": ["max", "mean"]}
INSTALLMENT_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
CARD_FUNCTIONS = ["min", "max", "mean", "sum", "var"]
BINARY = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
UNDATED = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"]


def clean_applications(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """Training and test rows together: binary codes, one-hot categories, unknown dates, ratios."""
    df = train if test is None else union_by_name(train, test)
    df = filter_not_equal(df, "CODE_GENDER", "XNA")
    for c in BINARY:
        df = factorize(df, c, [KEY])[0]
    df = one_hot(df, null_category=False)[0]
    df = null_sentinel(df, ["DAYS_EMPLOYED"], UNKNOWN_DAYS)
    # Names and columns of the ratios.
    return add_ratios(df, {
        "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
        "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
        "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
    })


def bureau_features(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Monthly balances to loans, loans to clients; active and closed loans in the same pass as all loans."""
    months = fit_one_hot(balance, ["STATUS"])
    per_loan = group_agg(balance, BUREAU_KEY, BALANCE_SPEC, extra=category_share_texts(months))
    loans = attach(bureau, per_loan, BUREAU_KEY).drop(BUREAU_KEY)
    kinds = fit_one_hot(bureau)
    shares = {f"{name}_MEAN": ["mean"] for name in months.new_columns()}
    return group_agg_where(
        kinds.add_to(loans), KEY, BUREAU_SPEC,
        {"ACTIVE_": col("CREDIT_ACTIVE") == "Active", "CLOSED_": col("CREDIT_ACTIVE") == "Closed"}, "BURO_",
        total={**BUREAU_SPEC, **{name: ["mean"] for name in kinds.new_columns()}, **shares})


def previous_features(previous: DataFrame) -> DataFrame:
    kinds = fit_one_hot(previous)
    undated = [c for c in UNDATED if c in previous.columns]
    df = add_ratios(null_sentinel(previous, undated, UNKNOWN_DAYS), {"APP_CREDIT_PERC": ("AMT_APPLICATION", "AMT_CREDIT")})
    return group_agg_where(
        kinds.add_to(df), KEY, PREVIOUS_SPEC,
        {"APPROVED_": col("NAME_CONTRACT_STATUS") == "Approved", "REFUSED_": col("NAME_CONTRACT_STATUS") == "Refused"},
        "PREV_", total={**PREVIOUS_SPEC, **{name: ["mean"] for name in kinds.new_columns()}})


def pos_features(pos: DataFrame) -> DataFrame:
    return group_agg(pos, KEY, POS_SPEC, "POS_",
                     {**category_share_texts(fit_one_hot(pos), "POS_"), "POS_COUNT": "count(1)"})


def installment_features(installments: DataFrame) -> DataFrame:
    late = col("DAYS_ENTRY_PAYMENT") - col("DAYS_INSTALMENT")
    df = replace_columns(installments, {
        "PAYMENT_PERC": ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
        "PAYMENT_DIFF": col("AMT_INSTALMENT") - col("AMT_PAYMENT"),
        "DPD": positive_part(late), "DBD": positive_part(-late)})
    return group_agg(df, KEY, INSTALLMENT_SPEC, "INSTAL_",
                     {**category_share_texts(fit_one_hot(installments), "INSTAL_"), "INSTAL_COUNT": "count(1)"})


def card_features(card: DataFrame) -> DataFrame:
    df = one_hot(card.drop(PREVIOUS_KEY))[0]
    return group_agg(df, KEY, {c: CARD_FUNCTIONS for c in df.columns if c != KEY}, "CC_",
                     {"CC_COUNT": "count(1)"})


def clean_and_aggregate(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Seven tables to one matrix with a row per application; column names made safe for model libraries."""
    parts = [
        lambda: clean_applications(tables["application_train"], tables.get("application_test")),
        lambda: bureau_features(tables["bureau"], tables["bureau_balance"]),
        lambda: previous_features(tables["previous_application"]),
        lambda: pos_features(tables["pos_cash_balance"]),
        lambda: installment_features(tables["installments_payments"]),
        lambda: card_features(tables["credit_card_balance"]),
    ]
    # Each part looks up the categories of its own table first: small jobs that need not wait for one another.
    with ThreadPoolExecutor(len(parts)) as pool:
        root, *rest = [f.result() for f in [pool.submit(p) for p in parts]]
    return sanitize_names(assemble(root, rest, KEY))[0]


# Average everything ------------------------------------------------------------------------------------------------

def _averages(df: DataFrame, key: str, counted: Sequence[str], hot: Mapping[str, str], prefix: str = "") -> DataFrame:
    """Mean of all numbers per key; ``hot`` maps string columns to the prefix of their 0/1 columns."""
    encoded = one_hot(df, list(hot), null_category=False, prefix=hot, keep_source=True)[0]
    return group_mean_numeric(encoded, key, counted, prefix)


def average_bureau(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    hot = one_hot(balance, ["STATUS"], null_category=False, prefix={"STATUS": "buro_bal_status"})[0]
    numbers = [c for c in hot.columns if c != BUREAU_KEY]
    per_loan = grouped(hot, BUREAU_KEY, {**{f"avg_buro_{c}": f"avg({quote(c)})" for c in numbers},
                                         "avg_buro_buro_count": "cast(count(MONTHS_BALANCE) as double)"})
    loans = merge_suffix(bureau, per_loan, [BUREAU_KEY], suffixes=("", "_bur_bal"))
    return _averages(loans, KEY, [BUREAU_KEY],
                     {"CREDIT_ACTIVE": "ca_", "CREDIT_CURRENCY": "cu_", "CREDIT_TYPE": "ty_"})


def average_everything(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Training and test matrices of plain averages; string columns of the root become codes learned on training rows."""
    train, test = tables["application_train"], tables["application_test"]
    for c in string_columns(train):
        codes = factorize_map(train, c, [KEY])
        train, test = apply_codes(train, c, codes), apply_codes(test, c, codes)
    previous = tables["previous_application"]
    # Prefixes of the averages and of the 0/1 columns.
    parts = [
        average_bureau(tables["bureau"], tables["bureau_balance"]),
        _averages(previous, KEY, [PREVIOUS_KEY], {c: c for c in string_columns(previous)}),
        _averages(tables["pos_cash_balance"], KEY, [PREVIOUS_KEY], {"NAME_CONTRACT_STATUS": ""}),
        _averages(tables["credit_card_balance"], KEY, [PREVIOUS_KEY], {"NAME_CONTRACT_STATUS": "cc_bal_status_"}, "cc_bal_"),
        _averages(tables["installments_payments"], KEY, [PREVIOUS_KEY], {}, "inst_"),
    ]

    def merged(root):
        for part in parts:
            root = merge_suffix(root, part, [KEY])
        return sanitize_names(root)[0]

    return merged(train), merged(test)
