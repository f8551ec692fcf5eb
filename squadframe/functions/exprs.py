"""Scalar rules as column expressions; each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def round_half_up(v: Column, digits: int = 0) -> Column:
    """Half towards plus infinity, on doubles."""
    k = float(10**digits)
    return F.floor(v * k + 0.5) / k


def fixed(v: Column, digits: int) -> Column:
    """Rounded to digits by the exact value of the double, halves away from zero, as fixed-point formatting does.

    The product with a power of ten has an error of its own, which matters just where it lies at a half. The error is
    itself a double (both factors are split into halves of 26 bits, whose products are exact), and its sign decides there.
    """
    k, cut = float(10**digits), 134217729.0
    k_high = k * cut - (k * cut - k)
    a = F.abs(v)
    p, wide = a * k, a * cut
    high = wide - (wide - a)
    low = a - high
    error = ((high * k_high - p) + high * (k - k_high) + low * k_high) + low * (k - k_high)
    whole = F.floor(p).cast("double")
    up = (p - whole > 0.5) | ((p - whole == 0.5) & (error >= 0))
    near = (whole + up.cast("int")) / k
    return F.when(p >= float(1 << 52), v).otherwise(F.when(v < 0, -near).otherwise(near))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def log_confidence(games: Column, full: float) -> Column:
    return clamp(F.log10(games + 1) / F.log10(F.lit(full + 1.0)), 0.0, 1.0)


def placement_score(placement: Column, top3: Column, win: Column) -> Column:
    raw = 1.35 * (4.5 - placement) / 3.5 + 1.15 * (top3 - 0.375) + 1.45 * (win - 0.125)
    return F.coalesce(clamp(raw, -2.4, 2.8), F.lit(0.0))


def placement_ranking(placement: Column, top3: Column, win: Column) -> Column:
    return F.coalesce(win, F.lit(0.0)) * 240 + F.coalesce(top3, F.lit(0.0)) * 150 + (4.5 - F.coalesce(placement, F.lit(4.5))) * 16


def tournament_result(rank: Column, total: Column, kills: Column) -> Column:
    return clamp(0.78 * (4.5 - rank) / 3.5 + 0.32 * F.least(F.lit(1.0), total / 22) + 0.28 * F.least(F.lit(1.0), kills / 14), -1.15, 1.35)


def bayesian_rate(wins: Column, games: Column, alpha: float, prior: Column) -> Column:
    return (wins + alpha * prior) / (games + alpha)


def recency_weight(at: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86400000000.0
    return F.when(at.isNull(), F.lit(1.0)).otherwise(F.exp(-0.02 * F.greatest(F.lit(0.0), days)))


def one_trick_weight(r: Column) -> Column:
    return F.when(r >= 0.82, 0.15).when(r >= 0.68, 0.35).when(r >= 0.52, 0.65).otherwise(1.0)


def vote_sentiment(likes: Column, dislikes: Column) -> Column:
    n = likes + dislikes
    return (likes - dislikes) / (n + 6.0) * F.least(F.lit(1.0), F.log2(n + 1.0) / 4)


def vote_score(likes: Column, dislikes: Column) -> Column:
    n = likes + dislikes
    return F.when(n > 0, (likes - dislikes) / n * F.least(F.lit(1.0), n / 5.0) * 1.5).otherwise(F.lit(0.0))


def vote_bonus(likes: Column, dislikes: Column) -> Column:
    n = likes + dislikes
    return F.when(n > 0, (likes - dislikes) / F.greatest(F.lit(1.0), n) * F.least(F.lit(1.0), F.log2(n + 1.0) / 5) * 42).otherwise(F.lit(0.0))


def rank_tier(score: Column) -> Column:
    return F.when(score >= 76, "S").when(score >= 66, "A").when(score >= 55, "B").when(score >= 44, "C").otherwise("D")


def tier_from_mmr(mmr: Column) -> Column:
    """Fine tier by fixed thresholds; null for a null or non-finite value."""
    steps = [(14000, "eternity"), (11000, "demigod"), (9000, "mithril"), (7500, "meteor"), (6000, "diamond"), (4500, "platinum"), (3000, "gold"), (1500, "silver")]
    out = F.when(mmr.isNull() | F.isnan(mmr) | (F.abs(mmr) == float("inf")), F.lit(None).cast("string"))
    for at, name in steps:
        out = out.when(mmr >= at, name)
    return out.otherwise("bronze")


def tier_from_text(text: Column) -> Column:
    """Fine tier by the first name that the text contains, in this order."""
    names = [("iron", "bronze"), ("bronze", "bronze"), ("silver", "silver"), ("gold", "gold"), ("platinum", "platinum"), ("diamond", "diamond"), ("meteor", "meteor"), ("mithril", "mithril"), ("demi", "demigod"), ("eternity", "eternity"), ("titan", "mithril_plus"), ("immortal", "mithril_plus")]
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for part, name in names:
        out = out.when(F.lower(text).contains(part), name)
    return out


def compact_tier(fine: Column) -> Column:
    return (
        F.when(fine.isin("bronze", "silver", "gold"), "iron_gold").when(fine.isin("platinum", "diamond"), "platinum_diamond")
        .when(fine.isin("meteor", "mithril", "mithril_plus"), "meteor_mithril").when(fine.isin("demigod", "eternity"), "demigod_eternity")
        .otherwise(F.coalesce(fine, F.lit("unknown")))
    )


def ranked_tier(tier_text: Column, mmr: Column, rank: Column) -> Column:
    """Text before MMR; the first 300 and 1000 ranks carry titles, unless the MMR is known to be below 6000."""
    eligible = (rank > 0) & (mmr.isNull() | (mmr >= 6000))
    return F.when(eligible & (rank <= 300), "eternity").when(eligible & (rank <= 1000), "demigod").otherwise(F.coalesce(tier_from_text(tier_text), tier_from_mmr(mmr)))


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def plain_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[&·.\\-_ '’]", "")


def initials(text: Column) -> Column:
    """Hangul syllables as their initial consonants, anything else unchanged."""
    lead = F.array(*[F.lit(c) for c in "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"])
    return F.array_join(
        F.transform(F.split(text, ""), lambda c: F.when((F.ascii(c) >= 44032) & (F.ascii(c) <= 55203), F.element_at(lead, ((F.ascii(c) - 44032) / 588).cast("int") + 1)).otherwise(c)), "")


def tier_weight(label: Column) -> Column:
    out = F.when(label == "OP", 1.4)
    for name, w in (("S", 1.1), ("A", 0.75), ("B", 0.3), ("C", -0.25), ("D", -0.65)):
        out = out.when(label == name, w)
    return out.otherwise(0.0)


def legacy_tier_from_mmr(mmr: Column) -> Column:
    """Tier by the older collector's thresholds."""
    out = F.when(mmr.isNull() | F.isnan(mmr), F.lit(None).cast("string"))
    for at, name in ((9000, "mithril_plus"), (7000, "diamond"), (5200, "platinum"), (3600, "gold"), (2000, "silver")):
        out = out.when(mmr >= at, name)
    return out.otherwise("bronze")


def relative_score(v: Column, base: Column, scale: float = 1.0) -> Column:
    return F.when(v.isNull() | base.isNull() | (base <= 0), 0.0).otherwise(clamp((v - base) / F.when(base > 0, base) * scale, -1.2, 1.2))


def placement_delta(v: Column, base: Column) -> Column:
    return F.coalesce(clamp((base - v) / 1.35, -1.2, 1.2), F.lit(0.0))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def slot_to_rect(slot: Column, ratio: Column, width: Column, height: Column) -> Column:
    """Pixels of a part (ratio) of a slot, both structs x, y, w, h of shares."""
    w, h = round_half_up(slot["w"] * width), round_half_up(slot["h"] * height)
    return F.struct(
        (round_half_up(slot["x"] * width) + round_half_up(w * ratio["x"])).alias("x"), (round_half_up(slot["y"] * height) + round_half_up(h * ratio["y"])).alias("y"),
        round_half_up(w * ratio["w"]).alias("w"), round_half_up(h * ratio["h"]).alias("h"))


#: Compound consonants and their two parts (fixed values).
COMPOUNDS = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}


def search_form(text: Column) -> Column:
    """Lower case, compound consonants in their parts."""
    out = F.lower(text)
    for c, parts in COMPOUNDS.items():
        out = F.replace(out, F.lit(c), F.lit(parts))
    return out


def matches_search(text: Column, query: Column) -> Column:
    """Whether the text or its initials contain the query; an empty query matches all."""
    q = search_form(F.trim(query))
    return (q == "") | search_form(text).contains(q) | initials(search_form(text)).contains(q)


def has_final_consonant(text: Column) -> Column:
    code = F.ascii(F.right(text, F.lit(1)))
    return F.coalesce(code.between(44032, 55203) & ((code - 44032) % 28 > 0), F.lit(False))


def with_particle(text: Column, after_consonant: str, after_vowel: str) -> Column:
    return F.concat(text, F.when(has_final_consonant(text), after_consonant).otherwise(after_vowel))


def squeezed_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s", ""))


def base64url(text: Column) -> Column:
    return F.translate(F.rtrim(F.base64(text.cast("binary")), F.lit("=")), "+/", "-_")


def safe_file_part(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(text, F.lit("")), F.lit("current")), "[^a-zA-Z0-9._-]", "_")


def mask_secret(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > 12, F.concat(F.left(t, F.lit(6)), F.lit("..."), F.right(t, F.lit(6)))).when(F.length(t) > 0, "[redacted]").otherwise("none")


def version_parts(version: Column) -> Column:
    """Numbers of a version such as v1.20.3; what is no number counts as 0."""
    clean = F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), "^[vV]", "")
    return F.transform(F.split(clean, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))


def compare_versions(a: Column, b: Column) -> Column:
    """The first difference of two versions, 0 if they are equal; missing parts count as 0."""
    gaps = F.zip_with(version_parts(a), version_parts(b), lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.coalesce(F.try_element_at(F.filter(gaps, lambda d: d != 0), F.lit(1)), F.lit(0))


def clean_id(value: Column) -> Column:
    """An id without its variant; empty for the names that mean none."""
    out = F.trim(F.split_part(F.trim(F.coalesce(value, F.lit(""))), F.lit(":"), F.lit(1)))
    return F.when(F.lower(out).isin("", "empty", "null", "undefined", "none"), "").otherwise(out)


def trait_place(kind: Column, order: Column) -> tuple[Column, Column]:
    """Category (core, sub1, sub2) and index from 0 of a trait by its type's name or its sort order; null for neither."""
    local, low = order % 100, F.lower(F.coalesce(kind, F.lit("")))
    category = (
        F.when(low.contains("core") | local.between(1, 4), "core").when(low.contains("sub1") | local.between(11, 14), "sub1").when(low.contains("sub2") | local.between(21, 24), "sub2")
    )
    index = local % 10 - 1
    return F.when(index >= 0, category), F.when(index >= 0, index)


#: Ordered patterns of a reason's text and the label that each adds (fixed values); the second one's label depends on a
#: further pattern.
REASON_LABELS = [
    ("(?i)앞라인|탱커|진입|받아치|front.?line|\\btank\\b|initiat|counter.fight", "frontlineNeeded"), ("마무리|킬캐치|화력|데미지|딜러 자리|damage|firepower|dealer", "damageNeeded"), ("CC|이니시|교전 시작|진입각|initiat|engage", "initiateNeeded"),
    ("보호|세이브|받아치|안정|protect|peel|alive|stable|counter.fight", "peelNeeded"), ("사거리|포킹|대치|poke|standoff|range", "pokeNeeded"), ("데미지 기여가 충분|화력을 보탤|화력을 채워|high.damage|fills.*firepower|fills.*damage", "damageOk"),
    ("데미지 기여가 부족|화력 총량이 부족|화력이 부족|low.damage|lacks.*damage|firepower.*shortage", "damageCaution"), ("평가 데이터|좋게 기록|랭커|전적|feedback.*data|ranker|tournament|good synergy", "dataOk"), ("감점|낮게 잡힐|위험|penalty|drag.*score|lower.*score", "caution"),
]
LOW_DAMAGE = "부족|모자|감점|low.damage|firepower.*short|penalty|below.average"


def reason_labels(text: Column) -> Column:
    """The first three labels of a text, by the patterns it has, in their order."""
    found = [F.when(text.rlike(p), F.when(text.rlike(LOW_DAMAGE), "damageLow").otherwise(k) if k == "damageNeeded" else F.lit(k)) for p, k in REASON_LABELS]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, 3)


def decoded_html(text: Column) -> Column:
    """Numeric (decimal and hexadecimal) character references decoded, then named ones; what names no character stays."""
    reference = r"^&#([xX][0-9a-fA-F]{1,6}|\d{1,7});"
    parts = F.split(text, r"(?=&#(?:[xX][0-9a-fA-F]{1,6}|\d{1,7});)")

    def one(part: Column) -> Column:
        said = F.regexp_extract(part, reference, 1)
        code = F.when(F.lower(F.left(said, F.lit(1))) == "x", F.conv(F.substring(said, 2, 6), 16, 10)).otherwise(said).try_cast("int")
        known = (said != "") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.regexp_replace(part, reference, ""))).otherwise(part)

    text = F.array_join(F.transform(parts, one), "")
    for a, b in (("&equals;", "="), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def message(table: dict[str, dict[str, str]], lang: Column, key: Column, params: dict[str, Column], fallback: str = "en") -> Column:
    """A message of a language, else of the fallback, else its key, with {name} replaced by the parameters."""
    known = {f"{a}:{k}": text for a, texts in table.items() for k, text in texts.items()}
    texts = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    at = lambda a: F.try_element_at(texts, F.concat(a, F.lit(":"), key))
    out = F.coalesce(at(F.coalesce(lang, F.lit(""))), at(F.lit(fallback)), key)
    for name, value in params.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
