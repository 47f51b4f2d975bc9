"""Text: normal forms, tokens, block keys, flags and feature columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters up to U+024F whose decomposition is one ASCII letter and marks, and their letters; the marks last, to be dropped."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) for d in [unicodedata.normalize("NFD", chr(c))] if len(d) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()

#: Aliases that are spelt out. Fixed values.
ALIASES = ((r"\baf\s?1\b", "air force 1"), (r"\baf1\b", "air force 1"), (r"\blv\b", "louis vuitton"))
#: Texts whose presence anywhere in a title is a warning. Fixed values.
NEGATIVE = (
    "replica", "fake", "falso", "tarocco", "ispirato", "inspired", "like", "stile", "lotto", "bundle", "stock", "solo scatola", "scatola", "dustbag",
    "ricambio", "solo", "rovinato", "strappato", "macchia", "difetto", "da riparare", "rott", "kids", "bambino", "bimbi", "ragazzo", "ragazza",
)
#: Title words that say nothing about the item. Fixed values.
GENERIC = (
    "the", "with", "and", "pour", "avec", "game", "games", "gioco", "giochi", "jeu", "juego", "ps4", "playstation", "borsa", "bag", "sac", "purse",
    "wallet", "portafoglio", "scarf", "prada", "gucci", "no", "brand", "uomo", "donna", "woman", "man",
)
#: Title patterns (word-bounded). Fixed values.
NEW_WORD = r"\b(?:new|nuov[aoei]?|nueva|neuf|neu|nwt|cartellino)\b"
AUTH_WORD = r"\b(?:original|authentic|autentico|autentica|vero|genuine)\b"
AUTH_WORD_SNAPSHOT = r"\b(?:original|authentic|autentico|vero|genuine)\b"
LIMITED_WORD = r"\b(?:limited edition|edizione limitata|raro|rara|rare)\b"
BUNDLE_WORD = r"\b(?:lotto|bundle|set|stock|blocco)\b"
DEFECT_WORD = r"\b(?:difett\w*|rovinat\w*|usurat\w*|macchiat\w*|strapp\w*|da riparare)\b"
PRICE_LIKE = r"(?i)(?:\b\d{1,3}(?:[.,]\d{1,2})?\s*[€$£]|\d{1,3}(?:[.,]\d{1,2})?\s*(?:euro|eur)\b|[€$£]\s*\d{1,3}(?:[.,]\d{1,2})?)"
URL = r"https?://\S+|www\.\S+"
MODEL_CODE = r"\b[a-z]{1,4}\d{2,6}\b|\b\d{2,4}\b"


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalise(c: Column) -> Column:
    """Lower case, accents folded, aliases spelt out, all but letters and digits to single spaces."""
    out = fold_accents(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))))
    for pattern, text in ALIASES:
        out = F.regexp_replace(out, pattern, text)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def normalise_title(c: Column, fold: bool = True) -> Column:
    """URLs dropped, all but a-z and 0-9 to single spaces; fold: accents first, as titles are compared; else they split words."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    out = F.lower(F.trim(out))
    out = fold_accents(out) if fold else out
    out = F.trim(F.regexp_replace(F.regexp_replace(out, URL, " "), r"[^a-z0-9]+", " "))
    return F.regexp_replace(out, "^nan$", "") if fold else out


def tokens(c: Column, pattern: str = r"[a-z0-9]+", least: int = 2) -> Column:
    """Tokens of a normalised text, of so many characters at least."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def model_codes(title: Column, most: int = 5) -> Column:
    """The first distinct codes (letters and digits, or 2 to 4 digits) of a normalised title."""
    return F.slice(F.array_distinct(F.regexp_extract_all(title, F.lit(MODEL_CODE), F.lit(0))), 1, most)


def block_key(brand: Column, title: Column) -> Column:
    """Items of unequal keys are never compared: brand with the title's codes, or else with its first two tokens."""
    name = F.coalesce(F.nullif(normalise(brand), F.lit("")), F.lit("nobrand"))
    codes, words = model_codes(title), F.slice(tokens(title), 1, 2)
    return (
        F.when(F.size(codes) > 0, F.concat(name, F.lit("__codes__"), F.array_join(codes, "-")))
        .when(F.size(words) > 0, F.concat(name, F.lit("__toks__"), F.array_join(words, "-")))
        .otherwise(F.concat(name, F.lit("__notoks")))
    )


def found_in(c: Column, words) -> Column:
    """Those of the words that stand anywhere in the text, as an array in the words' order."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def has_any(c: Column, words) -> Column:
    """Whether any of the words stands anywhere in the text, in lower case; a null text has none."""
    return F.size(found_in(c, words)) > 0


#: Words that place a search or title in a category, looked for in this order. Fixed values.
LUXURY_TERMS = ("gucci", "prada", "louis vuitton", "fendi", "dior", "balenciaga", "burberry", "chanel", "hermes")
GAME_TERMS = ("ps4", "ps5", "switch", "xbox", "game", "games", "playstation")


def category(search: Column, title: Column) -> Column:
    """luxury, game or generic, by the words of the search and the title together."""
    both = F.concat_ws(" ", F.coalesce(search, F.lit("")), F.coalesce(title, F.lit("")))
    return F.when(has_any(both, LUXURY_TERMS), "luxury").when(has_any(both, GAME_TERMS), "game").otherwise("generic")


def negative_flags(title: Column, words=NEGATIVE) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(title, w))


def informative_tokens(title: Column, brand: Column) -> Column:
    """Distinct tokens that are neither generic nor part of the brand nor digits only."""
    plain = F.array_except(F.array_distinct(tokens(title)), F.array(*map(F.lit, GENERIC)))
    return F.filter(F.array_except(plain, tokens(normalise(brand))), lambda t: ~t.rlike(r"^\d+$"))


def is_generic(informative: Column, has_code: Column) -> Column:
    """Whether a title names no product: one informative token at most, and no code."""
    return (informative <= 1) & ~has_code


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def without(words: Column, core: Column) -> Column:
    """The tokens that are not core tokens, in order, as text."""
    return F.array_join(F.filter(words, lambda t: ~F.array_contains(core, t)), " ")


def flag(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False)).cast("int")


def with_title_features(df: DataFrame, title: str, *names: str) -> DataFrame:
    """df with the title's features (all, or those named). The normalised title is a column made first, so it is worked out once a row."""
    made = df.withColumn("__norm", normalise_title(F.col(title)))
    found = title_features(F.col(title), F.col("__norm"))
    return made.select(*df.columns, *[c.alias(n) for n, c in found.items() if not names or n in names])


def title_features(title: Column, norm: Column | None = None) -> dict[str, Column]:
    """The title's features by name; norm: its normalised form, if there is a column of it."""
    raw = F.coalesce(title.cast("string"), F.lit(""))
    norm = normalise_title(title) if norm is None else norm
    words = tokens(norm, least=1)
    new, auth, limited, bundle, defect = (flag(norm, p) for p in (NEW_WORD, AUTH_WORD, LIMITED_WORD, BUNDLE_WORD, DEFECT_WORD))
    price = flag(raw, PRICE_LIKE)
    return {
        "title_norm": norm,
        "title_char_len": F.length(norm),
        "title_tokens": F.size(words),
        "title_unique_tokens": F.size(F.array_distinct(words)),
        "title_digit_tokens": F.size(F.filter(words, lambda t: t.rlike(r"\d"))),
        "title_has_digit": flag(norm, r"\d"),
        "title_has_new": new,
        "title_has_auth": auth,
        "title_has_limited": limited,
        "title_has_bundle": bundle,
        "title_has_defect": defect,
        "title_has_price": price,
        "title_positive": new + auth + limited,
        "title_caution": bundle + defect + price,
    }


def snapshot_features(title: Column, price: Column, likes: Column, page: Column, brand: Column, size: Column) -> dict[str, Column]:
    """The features of a listing's snapshot by name."""
    from .coerce import first_number

    raw = F.coalesce(title.cast("string"), F.lit(""))
    norm = normalise_title(title, fold=False)
    words = tokens(norm, least=1)
    n, letters = F.size(words), F.regexp_count(raw, F.lit("[A-Za-z]"))
    price_num, likes_num = first_number(price), first_number(likes)
    return {
        "price_num": price_num,
        "likes_num": likes_num,
        "page_num": first_number(page),
        "log_price": F.log1p(F.when(price_num.isNotNull(), F.greatest(price_num, F.lit(0.0)))),
        "log_likes": F.log1p(F.when(likes_num.isNotNull(), F.greatest(likes_num, F.lit(0.0)))),
        "title_char_len": F.length(raw),
        "title_token_count": F.size(tokens(raw, least=1)),
        "title_norm_char_len": F.length(norm),
        "title_norm_token_count": n,
        "title_unique_token_count": F.size(F.array_distinct(words)),
        "title_duplicate_token_ratio": F.when(n == 0, 0.0).otherwise(1.0 - F.size(F.array_distinct(words)) / n),
        "title_avg_token_len": F.when(n == 0, 0.0).otherwise(F.length(F.array_join(words, "")) / n),
        "title_punct_count": F.regexp_count(raw, F.lit(r"[^\p{L}\p{N}_\s]")),
        "title_upper_ratio": F.when(letters == 0, 0.0).otherwise(F.regexp_count(raw, F.lit("[A-Z]")) / letters),
        "title_has_digit": flag(raw, r"\d"),
        "title_has_new_word": flag(F.lower(raw), NEW_WORD),
        "title_has_auth_word": flag(F.lower(raw), AUTH_WORD_SNAPSHOT),
        "brand_present": (F.trim(F.coalesce(brand.cast("string"), F.lit(""))) != "").cast("int"),
        "size_num": first_number(size),
    }


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), F.lit("_"))


def status(c: Column) -> Column:
    """Status texts reduced to their letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]", "")
