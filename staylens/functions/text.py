"""Text, URL and page expressions. All are column expressions; a null text reads as empty where not said otherwise."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeaxis import col

# Phrases and what stands for them, applied in this order.
ALIASES = {
    "giuong doi": "double",
    "double bed": "double",
    "giuong don": "single",
    "single bed": "single",
    "giuong co king": "king",
    "giuong king": "king",
    "king bed": "king",
    "ban cong": "balcony",
    "huong bien": "sea view",
    "nhin ra bien": "sea view",
    "huong thanh pho": "city view",
    "nhin ra thanh pho": "city view",
    "phong": "room",
}
# Cities and the names they go by.
CITY_NAMES = {
    "Hồ Chí Minh": ["ho chi minh", "ho chi minh city", "hcm", "hcmc", "tp hcm", "tphcm", "sai gon", "saigon"],
    "Hà Nội": ["ha noi", "hanoi"],
    "Vũng Tàu": ["vung tau", "vungtau", "ba ria vung tau"],
    "Đà Lạt": ["da lat", "dalat"],
    "Phú Quốc": ["phu quoc", "phu quoc island"],
}
# Words that tell a room's tier, in order.
TIERS = {
    "suite": ["suite"],
    "deluxe": ["deluxe"],
    "superior": ["superior"],
    "studio": ["studio"],
    "family": ["family", "gia đình", "gia dinh"],
    "standard": ["standard", "tiêu chuẩn", "tieu chuan"],
}
# Patterns of room conditions and page texts.
BREAKFAST = "(?iu)bao gồm bữa sáng|bao bữa sáng|breakfast included"
FREE_CANCEL = "(?iu)miễn phí hủy|hủy miễn phí|free cancellation"
PAID_CANCEL = r"(?iu)không hoàn tiền|phí hủy[:\s]|non-?refundable"
CANCEL_WORD = "(?iu)hủy|hoàn tiền|refund|cancellation"
ROOMS_LEFT = r"(?iu)còn\s+(\d+)\s*(?:căn|phòng)"
TAX_LABEL = "(?:thuế và phí|thuế, phí|taxes and fees)"
TAX_IN = "(?iu)đã bao gồm thuế và phí|includes taxes and fees"
TAX_OUT = "(?iu)chưa bao gồm thuế và phí|excludes taxes and fees"
DISCOUNT = r"(?iu)(?:ti[ếe]t ki[ệe]m|gi[aả]m)\s+(\d+)%"
BADGE = r"(?isu)(?=.*(?:tiết kiệm|ưu đãi)).*?(\d+)\s*%"
CAPTCHA = "captcha|verify you are human|xác minh bạn là người"
BLOCKED = "access denied|request blocked|automated traffic"
NETWORK = "timeout|timed out|err_internet_disconnected|err_name_not_resolved|err_network_changed|err_connection_timed_out|err_connection_reset|err_connection_closed|dns_probe_finished_no_internet|failed to establish a new connection|temporary failure in name resolution"


# Patterns of areas, occupancy, taxes and error messages.
AREA = r"\d+\s*(?:m|ft)"
PEOPLE = r"\b([1-9])\s*(?:người|nguoi|person|people)\b"
TRIPLE, QUAD = r"\btriple\b", r"\bquad(?:ruple)?\b"
TAX_ADDED = rf"(?iu)\+\s*VND\s*([\d.,]+)[^\d]{{0,30}}{TAX_LABEL}"
TAX_AFTER = rf"(?iu){TAX_LABEL}[^\d]{{0,30}}VND\s*([\d.,]+)"
ROBOT = "captcha|verify you are human"
DENIED = "access denied|blocked|robot"
BROWSER = "driver|chrome|edge"


def _plain(c: str) -> str:
    """What a character is without marks and in its compatible form."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _accents() -> tuple[str, str, dict[str, str]]:
    """By rule: characters that stand for one ASCII letter or digit, and these; and those that stand for more."""
    told, plain, more = "đĐ", "dD", {}
    for c in map(chr, range(0xA0, 0x20000)):
        base = _plain(c)
        if base != c and any(x.isascii() and x.isalnum() for x in base):
            if len(base) == 1:
                told, plain = told + c, plain + base
            else:
                more[c] = base
    # what has no counterpart is deleted: the combining marks themselves
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
    return told + marks, plain, more


def _ranges(chars: str) -> str:
    """These characters as ranges of a class, whose parts are tried one after the other for each character of a text."""
    out = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


_FROM, _TO, _MORE = _accents()
_MORE_RANGES = _ranges("".join(_MORE))
_ANY_MORE = rf"(?![\x00-\x7F])[{_MORE_RANGES}]"


def _compositions() -> dict[str, str]:
    """By rule: each accented Latin letter by the ways to write it with combining marks."""
    out = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", c)
        for order in permutations(marks) if 0 < len(marks) < 4 else ():
            for k in range(len(marks)):
                out |= {x: c for x in [unicodedata.normalize("NFC", base + "".join(order[:k])) + "".join(order[k:])] if unicodedata.normalize("NFC", x) == c and unicodedata.normalize("NFC", c) == c}
    return out


# Letters with their marks, each by itself, and runs of what has none, which are bounded as a match calls itself for each.
_MARKED = "(?s)(?:.(?![\u0300-\u036f])){1,64}|.[\u0300-\u036f]*"


def _told(mapping: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")


def composed(text: str | Column) -> Column:
    """The text with letters and their combining marks in one; only texts with such marks are taken apart."""
    t = F.coalesce(col(text), F.lit(""))
    letters = F.transform(F.regexp_extract_all(t, F.lit(_MARKED), 0), lambda c: F.when(c.rlike("[\u0300-\u036f]"), F.coalesce(F.element_at(_told(_COMPOSED), c), c)).otherwise(c))
    return F.when(t.rlike("[\u0300-\u036f]"), F.array_join(letters, "")).otherwise(t)


_COMPOSED = _compositions()


def strip_accents(text: str | Column) -> Column:
    """ASCII letters and digits for what they are written with: accents, superscripts, full width, ligatures. ASCII texts are left as they are."""
    t = F.coalesce(col(text), F.lit(""))
    letters = F.transform(F.regexp_extract_all(t, F.lit(f"{_ANY_MORE}|[^{_MORE_RANGES}]+"), 0), lambda c: F.when(c.rlike(_ANY_MORE), F.coalesce(F.element_at(_told(_MORE), c), c)).otherwise(c))
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(F.when(t.rlike(_ANY_MORE), F.array_join(letters, "")).otherwise(t), _FROM, _TO)).otherwise(t)


def plain_words(text: str | Column) -> Column:
    """Lower-case ASCII letters and digits, one space between words."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " "))


def canonical_text(text: str | Column) -> Column:
    """plain_words() with the aliases put in, in their order; a text without any of them is left as it is."""

    def named(plain: Column) -> Column:
        replaced = reduce(lambda t, a: F.regexp_replace(t, rf"\b{a[0]}\b", a[1]), ALIASES.items(), plain)
        return F.when(plain.rlike(rf"\b(?:{'|'.join(ALIASES)})\b"), F.trim(F.regexp_replace(replaced, " +", " "))).otherwise(plain)

    return F.transform(F.array(plain_words(text)), named)[0]  # names the plain words once


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normal_area(text: str | Column) -> Column:
    """The first number with its unit, without the space between; else null."""
    return F.nullif(F.translate(F.regexp_extract(canonical_text(text), AREA, 0), " ", ""), F.lit(""))


def named(x: Column, of) -> Column:
    """of(x), with x worked out once however often it is named."""
    return F.transform(F.array(x), of)[0]


def _city(text: Column) -> Column:
    def told(padded: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for city, names in CITY_NAMES.items():
            out = out.when(reduce(lambda a, b: a | b, [padded.contains(f" {n} ") for n in names]), city)
        return out

    return named(F.concat(F.lit(" "), plain_words(text), F.lit(" ")), told)


def canonical_city(address: str | Column, market: str | Column) -> Column:
    """A city's name in the market hint, else in the address, as whole words; else null."""
    return F.coalesce(_city(col(market)), _city(col(address)))


def room_conditions(lines: str | Column) -> Column:
    """Struct of breakfast_included, free_cancellation, cancellation_policy and rooms_left of an array of lines.

    No line about breakfast is false; no lines at all are null. A later line about cancellation or rooms left decides.
    """
    some = F.size(F.coalesce(col(lines), F.array().cast("array<string>"))) > 0

    def told(lines: Column) -> Column:
        about = F.filter(lines, lambda x: x.rlike(FREE_CANCEL) | x.rlike(PAID_CANCEL))
        policy = F.array_join(F.filter(lines, lambda x: x.rlike(CANCEL_WORD)), " | ")
        left = F.filter(lines, lambda x: x.rlike(ROOMS_LEFT))
        return F.struct(
            F.when(some, F.exists(lines, lambda x: x.rlike(BREAKFAST))).alias("breakfast_included"),
            F.when(F.size(about) > 0, F.element_at(about, -1).rlike(FREE_CANCEL)).alias("free_cancellation"),
            F.nullif(policy, F.lit("")).alias("cancellation_policy"),
            F.when(F.size(left) > 0, F.regexp_extract(F.element_at(left, -1), ROOMS_LEFT, 1).cast("int")).alias("rooms_left"),
        )

    return named(F.filter(F.transform(col(lines), lambda x: F.trim(composed(x))), lambda x: x != ""), told)


def room_class(name: str | Column, occupancy: str | Column, breakfast: str | Column) -> Column:
    """Tier, occupancy bucket and breakfast, joined by underscores."""
    text = F.lower(composed(name))
    tier = F.when(F.lit(False), "")
    for label, words in TIERS.items():
        tier = tier.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), label)
    people = F.when(col(occupancy) <= 2, "1-2p").when(col(occupancy) > 2, "3p+").otherwise("unknown")
    return F.concat_ws("_", tier.otherwise("other"), people, F.when(F.coalesce(col(breakfast), F.lit(False)), "bf").otherwise("nobf"))


def occupancy_by_name(name: str | Column, scraped: str | Column) -> Column:
    """What the name says, never below what was scraped."""
    text = F.lower(composed(name))
    told = F.when(text.rlike(PEOPLE), F.regexp_extract(text, PEOPLE, 1).cast("int")).when(text.rlike(TRIPLE), 3).when(text.rlike(QUAD), 4)
    return F.greatest(told, col(scraped).cast("int"))


def url_path(url: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def hotel_slug(url: str | Column, first: str = "hotel") -> Column:
    """The last path segment up to its first dot, in lower case, if the path has two segments or more and begins with `first`."""
    parts = F.filter(F.split(url_path(url), "/"), lambda x: x != "")
    slug = F.lower(F.trim(F.substring_index(F.element_at(parts, -1), ".", 1)))
    return F.when((F.size(parts) >= 2) & (F.lower(F.get(parts, F.lit(0))) == first), F.nullif(slug, F.lit("")))


def last_segment(url: str | Column) -> Column:
    """The last path segment up to its first dot."""
    parts = F.filter(F.split(url_path(url), "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.lower(F.substring_index(F.element_at(parts, -1), ".", 1)))


def without_query(url: str | Column) -> Column:
    return F.regexp_replace(col(url), r"[?#][\s\S]*$", "")


def dated_url(url: str | Column, checkin: str | Column, checkout: str | Column) -> Column:
    """The search URL with the fixed context of every collection."""
    day = lambda x: F.date_format(col(x), "yyyy-MM-dd")
    return F.concat(without_query(url), F.lit("?group_adults=2&group_children=0&no_rooms=1&lang=vi&selected_currency=VND&checkin="), day(checkin), F.lit("&checkout="), day(checkout))


def query_value(url: str | Column, key: str) -> Column:
    return found(col(url), rf"[?&]{key}=([^&#]*)")


def url_agrees(url: str | Column, checkin: str | Column, checkout: str | Column) -> Column:
    """Whether both dates are in the URL's query."""
    day = lambda x: F.date_format(col(x), "yyyy-MM-dd")
    return F.coalesce((query_value(url, "checkin") == day(checkin)) & (query_value(url, "checkout") == day(checkout)), F.lit(False))


def price_number(text: str | Column) -> Column:
    """The first run of digits, dots and commas as a number without separators."""
    run = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"([\d.,]+)", 1)
    return F.nullif(F.translate(run, ".,", ""), F.lit("")).try_cast("double")


def tax_info(text: str | Column) -> Column:
    """Struct of price_includes_tax and the tax amount told apart."""
    t = F.trim(F.regexp_replace(composed(text), r"\s+", " "))
    amount = F.coalesce(found(t, TAX_AFTER), found(t, TAX_ADDED))
    return F.struct(F.when(t.rlike(TAX_IN), True).when(t.rlike(TAX_OUT) | t.rlike(TAX_ADDED), False).alias("price_includes_tax"), price_number(amount).alias("taxes_fees"))


def discount_percent(text: str | Column, badge: str | Column | None = None) -> Column:
    """The percent in the text, else in the badge."""
    told = found(composed(text), DISCOUNT)
    return F.coalesce(told, found(F.lower(composed(badge)), BADGE) if badge is not None else F.lit(None)).cast("int")


def page_state(text: str | Column, sold_out: list[str], not_bookable: list[str]) -> Column:
    """captcha, blocked, not_bookable, sold_out or open, in this order of precedence."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, [t.contains(w) for w in words], F.lit(False))
    return F.when(t.rlike(CAPTCHA), "captcha").when(t.rlike(BLOCKED), "blocked").when(any_of(not_bookable), "not_bookable").when(any_of(sold_out), "sold_out").otherwise("open")


def error_code(message: str | Column, default: str = "UNKNOWN") -> Column:
    t = F.lower(F.coalesce(col(message), F.lit("")))
    return F.when(t.rlike(NETWORK), "NETWORK_TIMEOUT").when(t.rlike(ROBOT), "CAPTCHA").when(t.rlike(DENIED), "BLOCKED").when(t.rlike(BROWSER), "DRIVER_INIT").otherwise(default)


#: Errors that no retry mends.
PERMANENT = ["PROPERTY_NOT_BOOKABLE", "INVALID_LINK", "SOLD_OUT"]


def retryable(code: str | Column) -> Column:
    """Whether a retry may mend the error."""
    return ~col(code).isin(PERMANENT)


def item_outcome(not_bookable: str | Column, sold_out: str | Column, rejected: str | Column, saved: str | Column, parsed: str | Column, duplicates: str | Column) -> Column:
    expected = F.greatest(F.lit(0), col(parsed) - col(duplicates))
    return F.when(col(not_bookable), "not_bookable").when(col(sold_out), "sold_out").when((col(rejected) > 0) | (col(saved) != expected), "partial").otherwise("success")


def token_similarity(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of the words of two canonical texts; 0 if either has none."""
    x, y = (F.filter(F.array_distinct(F.split(canonical_text(t), " ")), lambda w: w != "") for t in (a, b))

    def told(w: Column) -> Column:
        x, y = w["x"], w["y"]
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)

    return named(F.struct(x.alias("x"), y.alias("y")), told)


def tags_stripped(html: str | Column) -> Column:
    """Text of a page, as plainly as a check of stored values needs it."""
    t = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))
