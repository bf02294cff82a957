"""Scalar expressions: everything here is a Column, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .themes import THEME_PHRASES

#: Fixed values of the scoring rules.
MATE_FLOOR, CLAMP, ERROR_FLOOR, WIN_SCALE = 9000, 1000, 100, 400.0
THRESHOLDS = (0, 50, 100, 200)
EVAL_RANGE = (-2000, 2000)
FEN_PATTERN = r"^\S+ [wb] \S+ \S+ \d+ \d+$"


def clamp(value: Column, low, high) -> Column:
    """value within [low, high]; null stays null (greatest and least alone skip nulls)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def direction(value: Column, threshold: float) -> Column:
    return F.when(value > threshold, "White").when(value < -threshold, "Black").when(value.isNotNull(), "Equal")


def direction_correct(model: Column, truth: Column, threshold: float) -> Column:
    return direction(model, threshold) == direction(truth, threshold)


def relative_error(model: Column, truth: Column, floor: float = ERROR_FLOOR) -> Column:
    """|model - truth| relative to |truth|, which counts as ``floor`` at least."""
    if floor <= 0:
        raise ValueError("floor must be positive")
    return F.abs(model - truth) / F.greatest(F.abs(truth), F.lit(floor))


def exclude_mate(error: Column, truth: Column) -> Column:
    return F.when((F.abs(truth) < MATE_FLOOR) | truth.isNull(), error)


def white_to_move(fen: Column) -> Column:
    """Whether White moves; null for what isn't a FEN."""
    return F.when(fen.rlike(FEN_PATTERN), F.split(fen, " ")[1] == "w")


def eval_after(truth: Column, cpl: Column, white: Column) -> Column:
    return F.when(white, truth - cpl).when(~white, truth + cpl)


def _side_loss(before: Column, after: Column, white: Column) -> Column:
    return F.greatest(F.lit(0).cast("double"), F.when(white, before - after).otherwise(after - before).cast("double"))


def clamped_cpl(truth: Column, cpl: Column, white: Column, limit: int = CLAMP) -> Column:
    """Loss between evaluations clamped to +-limit, from 0 to 2 * limit."""
    after = eval_after(truth, cpl, white)
    return F.when(after.isNotNull(), _side_loss(clamp(truth, -limit, limit), clamp(after, -limit, limit), white))


def win_probability(cp: Column) -> Column:
    return 1 / (1 + F.exp(-cp / F.lit(WIN_SCALE)))


def wp_loss(truth: Column, cpl: Column, white: Column, limit: int = CLAMP) -> Column:
    """Loss of win probability for the side that moved, in thousandths."""
    after = eval_after(truth, cpl, white)
    before, then = win_probability(clamp(truth, -limit, limit)), win_probability(clamp(after, -limit, limit))
    return F.when(after.isNotNull(), _side_loss(before, then, white) * 1000)


def raw_cpl(before: Column, after: Column, white: Column) -> Column:
    return F.when(white, F.greatest(F.lit(0), before - after)).when(~white, F.greatest(F.lit(0), after - before))


def legal_attempted(move: Column, legal: Column) -> Column:
    return F.when(move.isNotNull(), legal)


def camel_words(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"(?<!^)(\p{Lu})", " $1"))


def names_theme(explanation: Column, theme: Column, phrases: Mapping[str, Sequence[str]] = THEME_PHRASES) -> Column:
    """1 if the explanation contains a phrase for the theme, else 0; null if either is null."""
    table = F.create_map(*[c for k, v in phrases.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.array(F.lower(theme), camel_words(theme), F.replace(F.lower(theme), F.lit("_"), F.lit(" ")))
    candidates = F.concat(F.coalesce(F.try_element_at(table, theme), F.array().cast("array<string>")), own)
    text = F.lower(explanation)
    found = F.exists(candidates, lambda p: (p != "") & F.contains(text, p))
    return F.when(explanation.isNotNull() & theme.isNotNull(), found.cast("int"))


def score_t1(model: Column, truth: Column, low: int = EVAL_RANGE[0], high: int = EVAL_RANGE[1]) -> dict[str, Column]:
    m, t = clamp(model, low, high), clamp(truth, low, high)
    known = model.isNotNull() & truth.isNotNull()
    return {"t1_absolute_error": F.when(known, F.abs(m - t)), "t1_direction_correct": F.when(known, direction_correct(m, t, 50))}


def score_t3(explanation: Column, side: Column, truth: Column, theme: Column) -> dict[str, Column]:
    p1 = F.when(explanation.isNotNull(), side.eqNullSafe(direction(truth, 50)).cast("int"))
    p2 = F.when(explanation.isNotNull(), F.coalesce(names_theme(explanation, theme), F.lit(0)))
    return {"t3_p1_side_correct": p1, "t3_p2_theme_correct": p2, "t3_score": p1 + p2}


def triggers_correction(cpl: Column, threshold: int = 50) -> Column:
    return F.coalesce(cpl > threshold, F.lit(False))


def rating_tier(rating: Column, bounds: Sequence[tuple[str, int, int]]) -> Column:
    """The tier whose half-open range holds the rating; the last tier for all others."""
    out = reduce(lambda acc, b: acc.when((rating >= b[1]) & (rating < b[2]), b[0]), bounds[1:], F.when((rating >= bounds[0][1]) & (rating < bounds[0][2]), bounds[0][0]))
    return out.otherwise(bounds[-1][0])


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts' texts, one after the other."""
    return F.sha2(F.concat(*(p.cast("string") for p in parts)), 256)


def id32(text: Column) -> Column:
    """The first 32 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def job_id(position: Column, model: Column, fmt: Column, trial: Column) -> Column:
    return F.format_string("job_%05d_%s_%s_%d", position, F.translate(model, ":.", "__"), fmt, trial)


#: Model-name prefixes that give the family.
FAMILY_PREFIXES = ("qwen", "llama", "mistral", "phi", "gemma")


def model_family(tag: Column) -> Column:
    name = F.lower(F.split(tag, ":")[0])
    chain = reduce(lambda acc, p: acc.when(name.startswith(p), p), FAMILY_PREFIXES[1:], F.when(name.startswith(FAMILY_PREFIXES[0]), FAMILY_PREFIXES[0]))
    return chain.otherwise("unknown")


def model_size(tag: Column) -> Column:
    digits = F.replace(F.lower(F.get(F.split(tag, ":"), 1)), F.lit("b"), F.lit(""))
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"-?\d+", 0), F.lit("")).try_cast("long")


def clean_move(text: Column) -> Column:
    """The first token of an answer's first line, without markup, final punctuation and move number."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\*\*|`", ""), r"^\s+|\s+$", "")
    token = F.regexp_extract(plain, r"^(\S*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(token, r"[.,;:]+$", ""), r"^\d+\.+", ""), F.lit(""))


def pieces(fen: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(F.split(fen, " ")[0], f"[^{kind}]", ""))


def phase(fen: Column, moves: Column) -> Column:
    """Opening, middlegame or endgame, from the number of moves and the material."""
    total, queens, minor = pieces(fen, "a-zA-Z"), pieces(fen, "qQ"), pieces(fen, "rbnRBN")
    return F.when((moves <= 20) & (total >= 28), "opening").when((total <= 10) | ((queens == 0) & (minor <= 4)), "endgame").otherwise("middlegame")


def moves_to_pgn(moves: Column) -> Column:
    return F.array_join(F.transform(moves, lambda m, i: F.when(i % 2 == 0, F.concat((i / 2 + 1).cast("int").cast("string"), F.lit(". "), m)).otherwise(m)), " ")


def first_theme(themes: Column, default: str = "tactics") -> Column:
    return F.coalesce(F.get(F.filter(F.split(themes, r"\s+"), lambda t: t != ""), 0), F.lit(default))


def short_name(model: Column) -> Column:
    return F.replace(F.replace(model, F.lit("deepseek-r1"), F.lit("ds-r1")), F.lit("command-r"), F.lit("cmd-r"))


def slug(name: Column) -> Column:
    return F.replace(F.translate(F.lower(name), " -", "__"), F.lit("."), F.lit(""))


def wdl_to_cp(win: Column, draw: Column) -> Column:
    """Centipawns from win and draw probabilities, cut towards zero, within +-10000."""
    s = win + draw / 2
    cp = (F.lit(111.714) * F.tan(F.lit(1.5620688) * (s - 0.5))).cast("int")
    return F.when(s >= 0.999, 10000).when(s <= 0.001, -10000).otherwise(F.greatest(F.lit(-10000), F.least(F.lit(10000), cp)))


def model_options(model: Column) -> Column:
    """Generation options: large models share the GPU and get a small context."""
    large = model.contains("70b") | model.contains("72b")
    return F.struct(F.when(large, 26).alias("num_gpu"), F.when(large, 512).otherwise(1024).alias("num_ctx"), F.lit(400).alias("num_predict"))


#: Fixed values: (pattern, parallel requests, workers); the first that matches counts, the last is for all others.
PARALLELISM = (
    ("72b", 1, 1),
    ("70b", 1, 2),
    ("mixtral", 2, 3),
    ("32b|34b|35b|26b|31b", 2, 4),
    ("deepseek-r1:14b", 2, 4),
    ("deepseek-r1", 4, 8),
    ("e2b|e3b", 6, 12),
    ("12b|13b|14b", 2, 4),
    ("7b|8b|9b|10b|11b", 3, 6),
    ("gemma4", 2, 4),
    ("", 12, 16),
)


def parallelism(model: Column) -> Column:
    rule = lambda k: F.coalesce(*(F.when(F.lower(model).rlike(r[0]), F.lit(r[k])) for r in PARALLELISM))
    return F.struct(rule(1).alias("num_parallel"), rule(2).alias("workers"))


def duration_seconds(text: Column) -> Column:
    """Seconds of 2h, 90m, 30s; a bare number is minutes."""
    n = F.regexp_extract(text, r"^(\d+)([hms]?)$", 1).try_cast("long")
    unit = F.regexp_extract(text, r"^(\d+)([hms]?)$", 2)
    return n * F.when(unit == "h", 3600).when(unit == "s", 1).otherwise(60)


def eta_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("~%dh %dm", h, m)).otherwise(F.format_string("~%dm %ds", m, s))


def progress_bar(done: Column, total: Column, width: int = 20, full: str = "#", rest: str = "-") -> Column:
    filled = F.coalesce(F.try_divide(done * width, total), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit(full), filled), F.repeat(F.lit(rest), F.lit(width) - filled))


def clean_number(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def round1(value: Column) -> Column:
    return F.bround(value, 1)


def engine_score(lines: Column, white: Column) -> Column:
    """Centipawns for White from an engine's output lines: the last score counts, mates are near 10000."""
    scored = F.filter(lines, lambda s: s.rlike(r"score (cp|mate) -?\d+"))
    last = F.try_element_at(scored, F.lit(-1))
    kind, n = F.regexp_extract(last, r"score (cp|mate) (-?\d+)", 1), F.regexp_extract(last, r"score (cp|mate) (-?\d+)", 2).try_cast("long")
    cp = F.when(kind == "cp", n).when(n > 0, 10000 - 10 * n).otherwise(-10000 - 10 * n)
    return F.when(last.isNotNull(), F.when(white, cp).otherwise(-cp))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def parse_stamp(text: Column) -> Column:
    return F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))
