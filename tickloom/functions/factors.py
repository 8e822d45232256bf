"""Market-factor analysis of a text: factors, direction, horizons, sectors, cautions.

``analyze`` adds the columns in three layers: lower-cased text, the factor array, then
everything derived from both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import contains_any

# Factor words in factor order, factor labels, and the implied-factor words.
FACTOR_WORDS = {
    "US_RISK": ("S&P500", "Nasdaq", "나스닥", "SOX", "필라델피아 반도체", "Nvidia", "엔비디아", "VIX"),
    "US_RATE": ("Fed", "FOMC", "미국 금리", "미국 10년물", "실질금리", "DXY", "달러 인덱스"),
    "FX_KRW": ("원/달러", "USD/KRW", "환율", "원화 약세", "원화 강세"),
    "SEMI": ("반도체", "HBM", "DRAM", "D램", "NAND", "낸드", "AI 서버", "CapEx", "삼성전자", "SK하이닉스"),
    "EXPORT": ("수출", "무역수지", "1~20일", "월간 수출", "수출입"),
    "CHINA": ("중국", "미중", "G2", "관세", "중국 부동산", "중국 소비"),
    "FLOW": ("외국인", "기관", "개인", "선물", "ETF", "신용잔고", "반대매매", "레버리지"),
    "BOK_CREDIT": ("BOK", "한국은행", "기준금리", "CPI", "물가", "가계부채", "PF"),
    "GOVERNANCE": ("밸류업", "배당", "자사주", "소각", "상법", "지배구조", "주주환원"),
    "ACCESS": ("공매도", "MSCI", "영문공시", "FX 개방", "옴니버스 계좌", "시장 접근성"),
    "GEO_OIL": ("중동", "호르무즈", "유가", "WTI", "Brent", "브렌트", "LNG", "이스라엘", "이란"),
}
FACTOR_LABELS = {
    "US_RISK": "미국 증시·위험선호", "US_RATE": "미국 금리·달러 유동성", "FX_KRW": "원/달러 환율", "SEMI": "반도체 사이클",
    "EXPORT": "수출·무역수지", "CHINA": "중국 경기·G2 리스크", "FLOW": "수급", "BOK_CREDIT": "국내 금리·신용",
    "GOVERNANCE": "주주환원·지배구조", "ACCESS": "제도·시장 접근성", "GEO_OIL": "지정학·유가",
}
IMPLIED_CREDIT = ("유가 급등", "수입물가", "CPI", "물가")
IMPLIED_GOVERNANCE = ("공매도", "상법", "밸류업")
# Direction words.
POSITIVE_WORDS = (
    "상승", "급등", "하락", "개선", "확대", "증가", "호조", "상향", "강세", "소각", "배당 확대", "주주환원", "수요 전망",
)
POSITIVE_BLOCKERS = ("금리 상승", "vix 상승", "유가 급등", "환율 급등")
NEGATIVE_WORDS = (
    "급락", "악화", "둔화", "축소", "피크아웃", "순매도", "매도", "원화 약세", "부실", "반대매매", "관세", "리스크",
)
MIXED_WORDS = ("원화 약세", "유가 상승", "유가가 급등", "중동", "공매도", "MSCI")
POSITIVE_BY_FACTOR = {
    "US_RISK": ("sox 지수가 급등", "nasdaq 상승", "나스닥 상승", "vix 하락"),
    "US_RATE": ("금리 하락", "달러 약세", "dxy 하락"),
    "SEMI": ("hbm", "상향", "가격 상승", "capex 확대", "수요"),
    "EXPORT": ("수출 증가", "무역수지 개선", "수출 호조"),
    "FLOW": ("순매수", "매수 확대"),
    "GOVERNANCE": ("배당 확대", "자사주 소각", "주주환원", "일반주주 보호"),
    "ACCESS": ("접근성 개선", "fx 개방", "영문공시", "msci"),
}
NEGATIVE_BY_FACTOR = {
    "US_RISK": ("미국 기술주 급락", "nasdaq 급락", "나스닥 급락", "sox 급락", "vix 상승"),
    "US_RATE": ("금리 상승", "실질금리 상승", "달러 강세", "dxy 상승"),
    "FX_KRW": ("원화 급락", "환율 급등", "원화 약세"),
    "FLOW": ("순매도", "선물 매도", "반대매매"),
    "GEO_OIL": ("유가 급등", "호르무즈 리스크", "중동"),
}
SELLING_WORDS = ("순매도", "선물 매도", "현물·선물 동반 매도", "원화 급락")
OIL_WORDS, OIL_EASING = ("유가", "호르무즈", "중동"), ("완화", "안정")
FX_SHOCK = ("환율 급등", "원/달러 환율이 급등", "원화 급락")
# Horizon words, horizons of each factor, market groups.
HORIZON_WORDS = {
    "short_term": ("미국 증시", "SOX", "Nvidia", "엔비디아", "USD/KRW", "원/달러", "외국인 선물", "유가", "VIX"),
    "medium_term": ("월별 수출", "월간 수출", "반도체 가격", "실적 가이던스", "BOK", "Fed", "CPI", "기준금리"),
    "long_term": ("ROE", "주주환원", "MSCI", "시장 접근성", "공급망", "지배구조", "상법", "밸류업"),
}
FACTOR_HORIZONS = {
    "US_RISK": ("short_term",), "US_RATE": ("medium_term",), "FX_KRW": ("short_term",), "SEMI": ("medium_term",),
    "EXPORT": ("medium_term",), "CHINA": ("medium_term",), "FLOW": ("short_term",), "BOK_CREDIT": ("medium_term",),
    "GOVERNANCE": ("long_term",), "ACCESS": ("long_term",), "GEO_OIL": ("short_term", "medium_term"),
}
KOSPI_FACTORS = ("US_RISK", "US_RATE", "SEMI", "EXPORT", "CHINA", "BOK_CREDIT", "GOVERNANCE", "ACCESS", "GEO_OIL")
KRW_FACTORS = ("FX_KRW", "BOK_CREDIT", "GEO_OIL")
SECTOR_FACTORS = ("SEMI", "EXPORT", "CHINA", "GOVERNANCE", "ACCESS", "GEO_OIL")
KOSDAQ_WORDS = ("신용", "KOSDAQ", "반대매매")
# Impact path phrases, sector reasons, cautions, summaries.
IMPACT_PATH = {
    "US_RISK": "미국 위험선호 변화",
    "US_RATE": "미국 금리·달러 유동성 변화",
    "FX_KRW": "원/달러 환율과 외국인 달러 수익률 변화",
    "SEMI": "국내 반도체 대형주 투자심리와 EPS 기대 변화",
    "EXPORT": "수출·무역수지 흐름이 기업이익 전망에 반영",
    "FLOW": "외국인·기관·개인 수급이 가격 변동성에 반영",
    "BOK_CREDIT": "국내 금리·물가·신용 부담이 밸류에이션에 반영",
    "GOVERNANCE": "주주환원·지배구조 개선 기대가 코리아 디스카운트에 반영",
    "ACCESS": "시장 접근성 개선 기대가 장기 자금 유입 가능성에 반영",
    "GEO_OIL": "유가·지정학 리스크가 수입물가와 위험 프리미엄에 반영",
}
IMPACT_PATH_UNKNOWN = "식별된 시장 영향 경로 부족"
SUMMARY_SUFFIX = {
    "positive": "중심의 긍정 이벤트",
    "negative": "중심의 부정 이벤트",
    "mixed": "영향이 엇갈릴 수 있는 혼합 이벤트",
    "neutral": "방향성이 제한적인 이벤트",
    "unknown": "방향성을 판단하기 어려운 이벤트",
}
SUMMARY_EMPTY = "명확한 한국 주식시장 요인을 식별하기 어려운 입력"
CAUTIONS_ALWAYS = ("투자 조언 아님", "확정되지 않은 전망을 사실처럼 단정하지 말 것")
CAUTION_FRESH = "최신 수치·정책 일정은 별도 확인 필요"
CAUTION_OIL = "방산·조선 중동 수혜는 조건부로만 해석하고 확정하지 말 것"
CAUTION_OIL_WORDS = ("중동", "호르무즈", "방산", "조선")
CAUTION_ACCESS = "MSCI 편입·워치리스트는 공식 발표 전 확정 금지"
CAUTION_FLOW = "외국인 순매수 금액만으로 결론 금지"
CAUTION_SEMI = "KOSPI 대형주 집중도는 계산 방식에 따라 달라질 수 있음"
# Words that call for fresh numbers, and the items to check.
FRESH_WORDS = (
    "오늘", "최신", "현재", "방금", "최근", "기준금리", "BOK", "Fed", "FOMC", "환율", "USD/KRW", "DXY", "KOSPI", "KOSDAQ",
    "외국인", "수출", "무역수지", "반도체 수출", "MSCI", "공매도", "상법", "밸류업", "유가", "WTI", "Brent", "브렌트",
    "호르무즈", "SOX", "HBM",
)
FRESH_ITEMS = (
    ("BOK 기준금리", ("BOK", "한국은행", "기준금리")),
    ("Fed/FOMC", ("Fed", "FOMC")),
    ("USD/KRW", ("USD/KRW", "원/달러", "환율", "원화 약세", "원화 강세")),
    ("DXY", ("DXY", "달러 인덱스")),
    ("KOSPI/KOSDAQ", ("KOSPI", "KOSDAQ")),
    ("외국인 수급", ("외국인",)),
    ("수출/무역수지", ("수출", "무역수지", "반도체 수출")),
    ("MSCI", ("MSCI",)),
    ("공매도", ("공매도",)),
    ("상법/밸류업", ("상법", "밸류업")),
    ("WTI/Brent", ("유가", "WTI", "Brent", "브렌트")),
    ("중동 리스크", ("호르무즈", "중동", "이스라엘", "이란")),
    ("SOX", ("SOX", "필라델피아 반도체")),
    ("HBM 수요 전망", ("HBM",)),
)

LOW, FACTORS = "_low", "factors"


def _has(code: str) -> Column:
    return F.array_contains(FACTORS, code)


def _has_any(codes) -> Column:
    return F.arrays_overlap(F.col(FACTORS), F.array(*[F.lit(c) for c in codes]))


def _low_any(words) -> Column:
    return contains_any(F.col(LOW), [w.lower() for w in words])


def _present(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def factor_array(text: Column, low: Column) -> Column:
    """Factors named in the text plus the two implied ones, in factor order."""
    named = {code: contains_any(low, [w.lower() for w in words]) for code, words in FACTOR_WORDS.items()}
    named["BOK_CREDIT"] = named["BOK_CREDIT"] | (named["GEO_OIL"] & contains_any(text, IMPLIED_CREDIT))
    named["GOVERNANCE"] = named["GOVERNANCE"] | (
        named["ACCESS"] & F.contains(text, F.lit("MSCI")) & contains_any(text, IMPLIED_GOVERNANCE)
    )
    return _present(*[(cond, code) for code, cond in named.items()])


def direction() -> Column:
    def by_factor(rules) -> Column:
        hit = F.lit(False)
        for code, words in rules.items():
            hit = hit | (_has(code) & _low_any(words))
        return hit

    positive = by_factor(POSITIVE_BY_FACTOR) | (_low_any(POSITIVE_WORDS) & ~_low_any(POSITIVE_BLOCKERS))
    negative = by_factor(NEGATIVE_BY_FACTOR) | _low_any(NEGATIVE_WORDS)
    oil = _has("GEO_OIL") & _low_any(OIL_WORDS)
    return (
        F.when(_low_any(SELLING_WORDS), "negative")
        .when(oil & ~_low_any(OIL_EASING), "mixed")
        .when(oil, "positive")
        .when(_has("FX_KRW") & _low_any(FX_SHOCK), "negative")
        .when(positive & negative, "mixed")
        .when(_low_any(MIXED_WORDS), "mixed")
        .when(positive, "positive")
        .when(negative, "negative")
        .when(F.size(FACTORS) > 0, "neutral")
        .otherwise("unknown")
    )


def horizons() -> Column:
    worded = [(_low_any(words), horizon) for horizon, words in HORIZON_WORDS.items()]
    implied = [(_has(code), h) for code, hs in FACTOR_HORIZONS.items() for h in hs]
    found = F.array_distinct(_present(*worded, *implied))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("short_term")))


def affected_markets(text: Column) -> Column:
    return _present(
        (_has_any(KOSPI_FACTORS), "KOSPI"),
        (contains_any(text, KOSDAQ_WORDS), "KOSDAQ"),
        (_has_any(KRW_FACTORS), "KRW"),
        (_has_any(SECTOR_FACTORS), "sector"),
        (_has("FLOW"), "foreign_flow"),
    )


def sector_impacts(text: Column) -> Column:
    """Array of (sector, direction, reason)."""

    def impact(cond: Column, sector: str, way: Column | str, reason: str) -> Column:
        value = F.lit(way) if isinstance(way, str) else way
        return F.when(cond, F.struct(F.lit(sector).alias("sector"), value.alias("direction"), F.lit(reason).alias("reason")))

    overall = F.col("direction")
    semi = F.when(overall.isin("positive", "mixed"), "positive").otherwise(overall)
    weak_won = F.contains(text, F.lit("원화 약세"))
    # Sector reasons.
    return F.array_compact(
        F.array(
            impact(_has("SEMI"), "semiconductor", semi, "SOX, HBM, DRAM/NAND 또는 AI CapEx 관련 반도체 심리 변화"),
            impact(_has("FX_KRW") & weak_won, "auto", "mixed", "원화 약세는 수출 환산이익과 외국인 수급에 엇갈린 영향"),
            impact(_has("GEO_OIL"), "manufacturing", "negative", "에너지 비용과 수입물가 부담"),
            impact(_has("GEO_OIL"), "defense", "mixed", "지정학 테마 가능성은 있으나 확정 수혜 아님"),
            impact(_has("GOVERNANCE"), "bank", "positive", "배당·자사주 소각·주주환원 기대"),
            impact(_has("CHINA"), "battery", "negative", "중국 경쟁과 G2 공급망 리스크"),
        )
    )


def impact_path() -> Column:
    steps = [(_has(code), text) for code, text in IMPACT_PATH.items()]
    return _present(*steps, (F.col("direction") == "unknown", IMPACT_PATH_UNKNOWN))


def cautions(text: Column) -> Column:
    always = [(F.lit(True), c) for c in CAUTIONS_ALWAYS]
    return _present(
        *always,
        (F.col("freshness_required"), CAUTION_FRESH),
        (_has("GEO_OIL") | contains_any(text, CAUTION_OIL_WORDS), CAUTION_OIL),
        (_has("ACCESS") & F.contains(text, F.lit("MSCI")), CAUTION_ACCESS),
        (_has("FLOW"), CAUTION_FLOW),
        (_has("SEMI"), CAUTION_SEMI),
    )


def summary() -> Column:
    labels = F.create_map(*[F.lit(x) for pair in FACTOR_LABELS.items() for x in pair])
    suffixes = F.create_map(*[F.lit(x) for pair in SUMMARY_SUFFIX.items() for x in pair])
    first = F.transform(F.slice(FACTORS, 1, 3), lambda code: labels[code])
    text = F.concat(F.array_join(first, ", "), F.lit(" "), suffixes[F.col("direction")])
    return F.when(F.size(FACTORS) > 0, text).otherwise(SUMMARY_EMPTY)


def analyze(df: DataFrame, text: str) -> DataFrame:
    """Add factors, direction, horizons, markets, sectors, path, freshness, cautions, confidence, summary."""
    body = F.col(text)
    out = df.withColumn(LOW, F.lower(body))
    out = out.withColumn(FACTORS, factor_array(body, F.col(LOW)))
    items = _present(*[(_low_any(words), label) for label, words in FRESH_ITEMS])
    out = out.withColumns({"direction": direction(), "freshness_items": items})
    out = out.withColumn("freshness_required", _low_any(FRESH_WORDS) | (F.size("freshness_items") > 0))
    unclear = (F.size(FACTORS) == 0) | (F.col("direction") == "unknown")
    return out.withColumns(
        {
            "horizons": horizons(),
            "affected_markets": affected_markets(body),
            "sector_impacts": sector_impacts(body),
            "impact_path": impact_path(),
            "cautions": cautions(body),
            "confidence": F.when(unclear, "low").otherwise("medium"),
            "summary": summary(),
        }
    ).drop(LOW)
