"""Signals of text quality, each between 0 (bad) and 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CID, WS, strip

# Patterns of wrongly decoded text, thresholds and weights.
MOJIBAKE = (r"[\x{c0}-\x{df}][\x{80}-\x{bf}]", r"\x{c3}[\x{a0}-\x{bf}]", r"\x{fffd}", r"[\x{c3}\x{a2}\x{a3}\x{a4}\x{a5}\x{a6}\x{a7}\x{a8}\x{a9}]", r"[\x{c0}-\x{24f}]{3,}")
WEIGHTS = {"encoding_health": 0.35, "cid_ratio": 0.30, "printable_ratio": 0.20, "language_consistency": 0.15}
PASS, REPAIR = 0.8, 0.4
READABLE = r"[\p{L}\p{N}\p{P}\p{S}]"
HANGUL = r"[\x{ac00}-\x{d7a3}\x{3131}-\x{318e}]"


_ONE = re.compile(r"\[(?:\\.|[^\[\]\\])*\]|\\[px]\{\w+\}")  # one character class


def chars(c: Column, one: str) -> Column:
    """The number of characters of a class: what taking away their runs takes from the length."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{one}+", ""))


def visible(c: Column) -> Column:
    """The number of characters that aren't white space."""
    return F.length(F.regexp_replace(c, f"[{WS}]+", ""))


def count(c: Column, pattern: str) -> Column:
    """The number of matches. regexp_count makes a list of them, which characters one by one are too many for."""
    return chars(c, pattern) if _ONE.fullmatch(pattern) else F.regexp_count(c, F.lit(pattern))


def encoding_health(c: Column) -> Column:
    """All signs of wrong decoding lie outside ASCII, so that plain texts aren't searched for them."""
    bad = count(c, r"\x{fffd}") + count(c, r"\p{Co}")
    for p in MOJIBAKE:
        bad = bad + count(c, p)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.greatest(F.lit(0.0), 1.0 - bad / F.length(c) * 3.0)).otherwise(1.0)


def cid_ratio(c: Column) -> Column:
    inside = F.length(c) - F.length(F.regexp_replace(c, CID, ""))
    return F.when(F.length(c) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - inside / F.length(c) * 2.0))


def printable_ratio(c: Column) -> Column:
    hidden = chars(c, r"[\p{C}&&[^\t\n\x0b\f\r\x1c-\x1f\x{85}]]")
    return F.when(F.length(c) == 0, 1.0).otherwise(1.0 - hidden / F.length(c))


def language_consistency(c: Column, expected: str = "ko") -> Column:
    """How well the letters agree with the expected language; accented Latin letters count against Korean."""
    total = visible(c)
    hangul, plain, wide = count(c, HANGUL), count(c, r"[\x{21}-\x{7e}]"), count(c, r"[\x{c0}-\x{24f}]")
    share = wide / F.nullif(total, F.lit(0))
    if expected == "ko":
        rule = (
            F.when((hangul > 0) & (share < 0.1), 1.0)
            .when(hangul > 0, F.greatest(F.lit(0.3), 1.0 - share * 3.0))
            .when(wide > 0, F.greatest(F.lit(0.2), 0.6 - share * 2.0))
            .when(plain > 0, 0.6).otherwise(0.5)
        )
    elif expected == "en":
        rule = F.when((plain + wide) / F.nullif(total, F.lit(0)) > 0.5, 1.0).otherwise(0.5)
    else:
        rule = F.lit(0.8)
    return F.when((F.length(strip(c)) < 5) | (total == 0), 1.0).otherwise(rule)


def signals(c: Column, expected: str = "ko") -> dict[str, Column]:
    return {"encoding_health": encoding_health(c), "cid_ratio": cid_ratio(c), "printable_ratio": printable_ratio(c), "language_consistency": language_consistency(c, expected)}


def composite(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + parts[name] * weight
    return out


def readable_ratio(c: Column) -> Column:
    """Share of readable characters among those that aren't white space; 1 where there are none."""
    total = visible(c)
    return F.when(total == 0, 1.0).otherwise(count(c, READABLE) / total)


def _odd(c: Column) -> Column:
    """Whether a text holds a character that is neither readable nor white space, or a replacement character; all of its visible ones are readable if not."""
    return c.rlike(rf"[^\x20-\x7e\n\p{{L}}\p{{N}}\p{{P}}\p{{S}}{WS}]") | c.contains("\ufffd")


def is_undecodable(c: Column) -> Column:
    """A text whose glyphs could not be decoded: many replacement or private-use characters, or few readable ones. Counted only where there are any such."""
    total = visible(c)
    return F.when(_odd(c), (total > 0) & ((count(c, r"[\x{fffd}\p{Co}]") / total >= 0.3) | (readable_ratio(c) < 0.3))).when(c.isNotNull(), False)


# Korean text: fixed word lists and unit syllables.
PARTICLES = "의 가 이 을 를 은 는 에 도 로 와 과 한 인 된 하 고 서 며 다 라 나 지 수 것 때 대 기 적".split()
USUAL_WORDS = (
    "이야기 우리 어디 아이 오이 이어 아우 여우 오아 우아 이유 의의 이익 의욕 이용 위원 의원 운영 요약 우위 유의 유아 유용 유익 이외 이웃 이전 아직 이후 여행 유지 역할 원인 영향 연구 예정 "
    "용도 의무 인원 인식 인정 우선 의견 일반 이상 이하 이내 이름 운동 위치 위험 원칙 월요일 요일 응답 약속 역사 연락 연습 열심 영어 오전 오후 완전 요청 용어 우수 원래 위반 유사 육아 읽기 입장 있어 있음 없어 없음"
).split()
UNITS = "년|월|일|장|조|항|호|절|편|관|개|명|건|원|세|회|차|번|권|급|종"
BEFORE_NUMBER = "제|약|총|전|현|매|각|이"
_SYL, _JAMO = r"[\x{ac00}-\x{d7a3}]", r"[\x{3131}-\x{3163}]"


def korean_garbled(c: Column) -> Column:
    """How broken a Korean text looks: six measures, combined by weight or by the strongest."""
    t = strip(c)
    syl, jamo = count(t, _SYL), count(t, _JAMO)
    korean = syl + jamo
    zero = F.lit(0.0)
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    solid = F.regexp_replace(t, f"[{WS}]+", "")
    # pairs of neighbours of which one is a lone letter and the other a letter or syllable
    odd = count(solid, rf"{_JAMO}(?={_JAMO}|{_SYL})|{_SYL}(?={_JAMO})")
    bigram = F.when(korean > 1, F.least(F.lit(1.0), ratio(odd, korean - 1))).otherwise(zero)
    mixed = count(t, r"[0-9][가-힣]|[가-힣][0-9]") + count(t, rf"[0-9][{WS}]+[가-힣]|[가-힣][{WS}]+[0-9]")
    natural = count(t, rf"(?:{BEFORE_NUMBER})\d|\d+(?:년|월|일|장|조|항|호|절|편|관|개|명|건|원|세|%|회|차|번|권|급|종)")
    extra = F.greatest(mixed - natural, F.lit(0))
    mix = F.when((extra > 0) & (syl > 0), F.least(F.lit(1.0), ratio(extra, syl))).otherwise(zero)
    words = F.filter(F.split(t, f"[{WS}]+"), lambda w: w != "")
    kwords = F.filter(words, lambda w: w.rlike(f"{_SYL}|{_JAMO}"))
    k = F.size(kwords)
    single = F.filter(kwords, lambda w: w.rlike(r"^(?:[0-9]?[가-힣]|[가-힣])$") & ~w.isin(PARTICLES))
    vowel = F.filter(kwords, lambda w: w.rlike(r"^[으어이오우아에의]$"))
    frag = F.when(k >= 3, F.greatest(ratio(F.size(single), k), ratio(F.size(vowel), k))).otherwise(zero)
    number = rf"^(?:(?:{BEFORE_NUMBER})\d+(?:{UNITS})|\d[\d,]*(?:{UNITS}))$"
    glued = lambda w: w.rlike(r"\d") & w.rlike(_SYL) & (F.length(w) >= 2) & ~w.rlike(number)
    # syllables that begin with a silent consonant are two runs of code points
    silent = lambda w: (count(w, _SYL) >= 2) & ~w.rlike(_JAMO) & (count(w, r"[\x{c544}-\x{c78f}]") == count(w, _SYL)) & ~w.isin(USUAL_WORDS)
    nonsense = F.when(k >= 2, ratio(F.size(F.filter(kwords, lambda w: glued(w) | silent(w))), k)).otherwise(zero)
    digits = F.size(F.filter(words, lambda w: w.rlike(r"^\d$")))
    digit = F.when((F.size(words) >= 3) & (digits >= 2), ratio(digits, F.size(words))).otherwise(zero)
    lone = ratio(jamo, korean)
    weighted = lone * 0.25 + bigram * 0.20 + mix * 0.20 + frag * 0.10 + nonsense * 0.15 + digit * 0.10
    return F.when(korean == 0, zero).otherwise(F.least(F.lit(1.0), F.greatest(weighted, lone * 0.70, bigram * 0.55, mix * 0.45, nonsense * 0.75, digit * 0.55)))


def _korean_part(t: Column) -> Column:
    """The Korean measures only where there is Korean; a condition that Spark doesn't evaluate beforehand."""
    return F.when(t.rlike(f"{_SYL}|{_JAMO}"), korean_garbled(t)).otherwise(0.0)


def is_garbled(c: Column) -> Column:
    t = strip(c)
    return F.when(t == "", False).when(F.when(_odd(t), readable_ratio(t) < 0.3).otherwise(False), True).otherwise(_korean_part(t) >= 0.3)


def garbled_ratio(c: Column) -> Column:
    t = strip(c)
    return F.when(t == "", 0.0).otherwise(F.greatest(1.0 - readable_ratio(t), _korean_part(t)))


def gate(c: Column, expected: str = "ko") -> dict[str, Column]:
    """The decision about a text: whether it passes, and which repair it gets (the codec repair apart, see functions.codec)."""
    s = signals(c, expected)
    score = composite(s)
    bare = strip(F.regexp_replace(c, CID, ""))
    short = F.length(bare) <= F.length(c) * 0.3
    broken = (score < PASS) & (s["cid_ratio"] < 0.7) & (bare != "")
    repaired = F.when(broken & ~short, bare)
    low = repaired.isNull() & (score < REPAIR)
    method = F.when(score >= PASS, "none").when(low, "confidence_downgrade").when(repaired.isNotNull(), "cid_strip").when(broken, "confidence_downgrade").otherwise("none")
    penalty = F.when(score >= PASS, 0.0).when(low, 0.5).when(repaired.isNotNull(), 0.2).when(broken, 0.4).otherwise(0.0)
    return {"quality_score": score, "needs_repair": score < PASS, "repaired_text": repaired, "repair_method": method, "confidence_penalty": penalty}


# Least scores by type of block.
TYPE_LEAST = {"table": 0.75, "figure": 0.50, "chart": 0.50, "unknown": 0.80}
OTHER_LEAST, LOW_CONFIDENCE, SEVERE, MODERATE, MIN_TEXT = 0.60, 0.6, 0.50, 0.20, 5


def block_scores(blocks, least: float | None = None):
    """Adds garbled, block_score, needs_retry and fallback to blocks (text, block_type, confidence); ``least`` overrides the limits by type."""
    g = garbled_ratio(F.coalesce("text", F.lit("")))
    limit = F.lit(least) if least else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_LEAST.items() for x in kv]), F.col("block_type")), F.lit(OTHER_LEAST))
    b = blocks.withColumn("garbled", g)
    b = b.withColumn("block_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * (1 - F.col("garbled")))))
    b = b.withColumn("needs_retry", (F.col("block_score") < limit) | (F.col("confidence") < LOW_CONFIDENCE) | (F.col("garbled") > MODERATE))
    how = F.when((F.col("garbled") > SEVERE) | (F.length(strip(F.coalesce("text", F.lit("")))) < MIN_TEXT), "vlm").when(F.col("garbled") > MODERATE, "ocr").otherwise("none")
    return b.withColumn("fallback", F.when(F.col("needs_retry"), how).otherwise("none"))
