import random
import re
import unicodedata
from collections import Counter

import pytest

from staylens.llm import quality
from staylens.llm.queries import RULES

from .samples import DOCS


def _base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_base_measures_equal_brute_force(docs):
    rows = quality.score(docs, RULES).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter((d, *_base(t)) for d, t, _ in DOCS)
    assert all(not (r.kept and r.base_failed) for r in rows)


def test_bands(spark, docs):
    kept = {r.doc_id for r in quality.score(docs, RULES).filter("kept").collect()}
    assert {0, 1, 7, 16} <= kept
    assert 15 not in kept
    good = quality.keep_good(docs, RULES)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == kept
    assert quality.keep_good(docs.limit(0), RULES).count() == 0


def test_script():
    assert quality.script("abc где") in ("LATIN", "CYRILLIC")
    assert quality.script("погода ok") == "CYRILLIC"
    assert quality.script("12 !") == ""


def verdict(text, lang):
    """Measures and verdict worked out one by one, with the libraries' plain calls."""
    import math
    from collections import Counter

    import sentencepiece
    import tiktoken

    from staylens.llm import queries

    rules, text = queries.RULES, text or ""
    pieces = sentencepiece.SentencePieceProcessor(model_file=rules.piece_path).encode_as_pieces(text)
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(rules.byte_path, "rb"))}
    fine = tiktoken.Encoding("t", pat_str=rules.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    share = [n / len(pieces) for n in Counter(pieces).values()]
    fallback = sum(re.fullmatch("<0x[0-9A-F]{2}>", x) is not None for x in pieces) / len(pieces) if pieces else 0.0
    told = (len(text) / max(1, len(fine)), len(text) / max(1, len(pieces)), fallback, -sum(x * math.log2(x) for x in share))
    names = Counter(unicodedata.name(c, "").split(" ")[0] for c in text if c.isalpha())
    main = max(names, key=lambda k: (names[k], k), default="")
    band = quality.LANGUAGES.get(lang) or quality.SCRIPTS.get(main) or quality.SCRIPTS[""]
    n_words, _, _, _, n_repeat, failed = _base(text)
    kept = not failed and band.byte_chars_per_token[0] <= told[0] <= band.byte_chars_per_token[1] and band.piece_chars_per_token[0] <= told[1] <= band.piece_chars_per_token[1] and told[2] <= band.fallback_share and band.entropy[0] <= told[3] <= band.entropy[1]
    return told, kept


NATURAL = {
    "CJK": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。", "HANGUL": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며", "ARABIC": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء",
    "CYRILLIC": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью", "THAI": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม",
}
LETTERS = {"CJK": (0x4E00, 0x9FA5), "HANGUL": (0xAC00, 0xD7A3), "ARABIC": (0x621, 0x64A), "CYRILLIC": (0x410, 0x44F), "THAI": (0xE01, 0xE2E)}


def test_measures_and_verdicts_equal_brute_force(spark):
    from staylens.llm import queries

    from .samples import prose

    r = random.Random(2)
    rows = [(t, g) for _, t, g in DOCS] + [(prose(200, 41), "en"), (prose(200, 42).upper(), "de"), ("%$# @!" * 300, "en")]
    for script, (a, b) in LETTERS.items():
        rows += [(" ".join(NATURAL[script].split()) , None), (" ".join("".join(chr(r.randint(a, b)) for _ in range(5)) for _ in range(80)), None)]
    got = quality.score(spark.createDataFrame([(i, t, g, 1.0) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, kept double"), queries.RULES).collect()
    for x in got:
        told, kept = verdict(*rows[x.doc_id])
        assert (x.byte_chars_per_token, x.piece_chars_per_token, x.fallback_share, x.token_entropy) == pytest.approx(told, abs=1e-9)
        assert x.kept == kept
    assert any(x.kept for x in got)


@pytest.mark.parametrize("script", sorted(NATURAL))
def test_scripts_tell_prose_from_random_letters(script):
    from staylens.llm import queries

    r, (a, b) = random.Random(4), LETTERS[script]
    noise = "".join(chr(r.randint(a, b)) if r.random() > 0.15 else " " for _ in range(200))
    band = quality.SCRIPTS[script]
    inside = []
    for text in (NATURAL[script], noise):
        by_byte, by_piece, fallback = next(quality._measures(queries.RULES, [text], [text.encode()], [None]))[5:8]
        inside.append(by_byte >= band.byte_chars_per_token[0] and by_piece >= band.piece_chars_per_token[0] and fallback <= band.fallback_share)
    assert inside == [True, False]


def test_bands_are_fitted_by_language(spark):
    from staylens.llm import queries

    from .samples import prose

    rows = [(i, prose(150, 300 + i), "en" if i % 2 else "de") for i in range(20)] + [(50, "%$# @!" * 300, "en")]
    docs = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, lang string, quality string")
    labels = spark.createDataFrame([(i, int(i != 50)) for i, _, _ in rows], "doc_id long, quality int")
    fitted = {x.lang: x for x in quality.fit_bands(docs, labels, queries.RULES).collect()}
    told = [verdict(t, g)[0] for i, t, g in rows if g == "en" and i != 50]
    assert fitted["en"].n == 10 and fitted["de"].n == 10
    assert min(x[0] for x in told) * 0.93 <= fitted["en"].byte_low <= min(x[0] for x in told)
    assert quality.fit_bands(docs, labels.limit(0), queries.RULES).count() == 0
