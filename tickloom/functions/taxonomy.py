"""Keyword taxonomies of disclosure and news titles as ordered column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.text import contains_any

# Ordered disclosure rules (words, detail type, event type, direction,
# importance, required numbers, flags).
DISCLOSURE_RULES = (
    (("단일판매", "공급계약", "판매공급계약"), "large_contract", "contract", "positive", 0.9, ("contract_amount", "contract_period"), ()),
    (("계약해지", "계약취소", "공급계약해지"), "contract_cancel", "contract", "negative", 0.9, ("contract_amount",), ("contract_cancelled",)),
    (("유상증자", "신주인수권부사채", "전환사채"), "capital_raise", "capital_raise", "negative", 1.0, ("issue_amount", "dilution_rate"), ("dilution_risk",)),
    (("소송", "횡령", "배임"), "litigation", "legal", "negative", 1.2, ("claim_amount",), ("legal_risk",)),
    (("매매거래정지", "거래정지"), "trading_halt", "other", "negative", 1.2, (), ("trading_halt",)),
)
DISCLOSURE_DEFAULT = ("other", "other", "neutral", 0.3, (), ())
# Ordered disclosure categories.
CATEGORY_RULES = (
    (("공급계약", "계약"), "contract"),
    (("잠정실적", "실적"), "earnings"),
    (("유상증자", "무상증자"), "equity_financing"),
    (("전환사채", "신주인수권부사채", "cb", "bw"), "convertible_financing"),
    (("자기주식", "자사주", "소각"), "shareholder_return"),
    (("최대주주", "경영권"), "control_change"),
    (("합병", "분할"), "mna_restructuring"),
    (("조회공시", "불성실공시"), "compliance_query"),
)
CATEGORY_DEFAULT = "general_disclosure"
# Impact labels and their words.
IMPACT_LABELS = (
    ("contract", ("계약", "공급", "수주", "contract", "supply", "order")),
    ("earnings", ("실적", "적자", "흑자", "매출", "영업이익", "earnings", "profit", "loss")),
    ("capital_raise", ("증자", "유상증자", "capital raise", "rights offering")),
    ("legal", ("소송", "제재", "벌금", "lawsuit", "sanction", "fine")),
    ("mna", ("인수", "합병", "m&a", "acquisition", "merger")),
    ("investment", ("투자", "investment")),
    ("disclosure", ("공시", "disclosure")),
    ("recall", ("리콜", "recall")),
)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def disclosure_event(title: str | Column) -> Column:
    """Struct of the first rule whose word occurs in the title without spaces and middle dots."""
    v = F.col(title) if isinstance(title, str) else title
    text = F.regexp_replace(v, "[ㆍ ]", "")

    def event(detail, kind, direction, importance, numbers, flags) -> Column:
        return F.struct(
            F.lit(detail).alias("detail_event_type"),
            F.lit(kind).alias("impact_event_type"),
            F.lit(direction).alias("base_direction"),
            F.lit(float(importance)).alias("base_importance"),
            _strings(numbers).alias("required_numbers"),
            _strings(flags).alias("risk_flags"),
        )

    words, *first = DISCLOSURE_RULES[0]
    chain = F.when(contains_any(text, words), event(*first))
    for words, *rest in DISCLOSURE_RULES[1:]:
        chain = chain.when(contains_any(text, words), event(*rest))
    return chain.otherwise(event(*DISCLOSURE_DEFAULT))


def disclosure_category(title: str | Column) -> Column:
    v = F.col(title) if isinstance(title, str) else title
    words, label = CATEGORY_RULES[0]
    chain = F.when(contains_any(v, words), label)
    for words, label in CATEGORY_RULES[1:]:
        chain = chain.when(contains_any(v, words), label)
    return chain.otherwise(CATEGORY_DEFAULT)


def impact_labels(title: str | Column) -> Column:
    v = F.lower(F.col(title) if isinstance(title, str) else title)
    return F.array_compact(F.array(*[F.when(contains_any(v, words), label) for label, words in IMPACT_LABELS]))
