"""Lexical augmentation: synonym replacement, random insertion, swap and deletion over whole texts.

Draws come from the row's key, so a text is edited the same way wherever and however often it is computed.
Synonyms come from a lexicon table ``word, synonyms``."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import let, settle
from chatloom.functions.rng import above, hash_hex, index_below, key_columns, uniform
from chatloom.functions.text import clean_chars, is_blank, words
from chatloom.operators import word_filter
from chatloom.plans.materialize import materialize

# Words never replaced by a synonym, next to the empty word.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers"
    " herself it its itself they them their theirs themselves what which who whom this that these those am is are"
    " was were be been being have has had having do does did doing a an the and but if or because as until while"
    " of at by for with about against between into through during before after above below to from up down in out"
    " on off over under again further then once here there when where why how all any both each few more most"
    " other some such no nor not only own same so than too very s t can will just don should now"
).split()

OPERATIONS = ("synonym", "insert", "swap", "delete")
INSERT_TRIES = 9
SWAP_TRIES = 3
KNOWN = "array<struct<word:string,synonyms:array<string>>>"
BROADCAST_WORDS = 500_000  # a lexicon up to this many words and characters is broadcast,
BROADCAST_CHARS = 64 * 2**20  # a larger one is joined by shuffle
PART = 256  # texts that are Python objects at once; an Arrow batch holds up to 64 MB, many times more as words
FREQUENT = 1000  # in that shuffle, words of at least 1/FREQUENT of all uses are broadcast, which are no more


def clean_column(df: DataFrame, column: str, out: str = "clean") -> DataFrame:
    return df.withColumn(out, clean_chars(F.col(column)))


def normalize_lexicon(lexicon: DataFrame) -> DataFrame:
    """``word, synonyms``: lower-case letters and spaces only, sorted, without the word itself."""
    raw = lexicon.select(F.col("word"), F.explode("synonyms").alias("s"))
    plain = F.regexp_replace(F.lower(F.regexp_replace("s", "[_-]", " ")), "[^ a-z]", "")
    return (
        raw.select("word", plain.alias("s"))
        .filter((F.col("s") != F.col("word")) & ~is_blank(F.col("s")))
        .groupBy("word")
        .agg(F.sort_array(F.collect_set("s")).alias("synonyms"))
    )


def _is_small(lexicon: DataFrame) -> bool:
    size = F.length("word") + F.aggregate("synonyms", F.lit(0), lambda n, x: n + F.length(x))
    found = lexicon.limit(BROADCAST_WORDS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return found["n"] <= BROADCAST_WORDS and (found["b"] or 0) <= BROADCAST_CHARS


def merge_words(lexicon: DataFrame) -> DataFrame:
    """One row per word: the synonyms of all its rows, sorted, each once."""
    every = F.flatten(F.collect_list("synonyms"))
    return lexicon.groupBy("word").agg(F.sort_array(F.array_distinct(every)).alias("synonyms"))


_KNOWN_TYPE = pa.list_(pa.struct([("word", pa.string()), ("synonyms", pa.list_(pa.string()))]))


def parts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[list, ...]]:
    """The rows of Arrow batches, a few at a time."""
    for batch in batches:
        for start in range(0, len(batch[0]), PART):
            yield tuple(a.slice(start, PART).to_pylist() for a in batch)


def _known_from_dictionary(own: Column, shared) -> Column:
    """Lookup in a broadcast dictionary, a few rows at a time, where the texts are."""

    @F.arrow_udf(KNOWN)
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        synonyms = shared.value
        for (rows,) in parts((b,) for b in batches):
            found = (sorted(w for w in words or () if w in synonyms) for words in rows)
            yield pa.array([[{"word": w, "synonyms": synonyms[w]} for w in f] for f in found], _KNOWN_TYPE)

    return known(own)


def _known_from_join(df: DataFrame, keys: list[str], lexicon: DataFrame):
    """Lookup by join for a lexicon of any size: a dictionary of the frequent words, and ``_rest`` of each text that has
    other words of the lexicon. Words that a filter of the lexicon's rules out never move. A word most texts hold would meet
    in one task: the few words that make up a large share of all uses are a broadcast dictionary and stay where the texts
    are, the others meet in a shuffle where none is frequent. A text's words come together again before they move."""
    shared = df.sparkSession.sparkContext.broadcast(word_filter.build(lexicon))
    own = word_filter.keep_possible(df.select(*keys, "_own"), "_own", shared)
    uses = own.select(F.explode("_own").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_uses"))
    uses = materialize(lexicon.select("word").join(uses, "word"))
    total = uses.agg(F.sum("_uses")).first()[0] or 0
    often = uses.filter(F.col("_uses") * FREQUENT >= F.lit(total)).select("word")
    hot = {r["word"]: list(r["synonyms"]) for r in lexicon.join(F.broadcast(often), "word").collect()}
    rest = own.select(*keys, F.explode(F.array_except("_own", F.array(*map(F.lit, hot)).cast("array<string>"))).alias("word"))
    rest = rest.join(lexicon, "word").groupBy(*keys).agg(F.collect_list(F.struct("word", "synonyms")).alias("_rest"))
    return df.sparkSession.sparkContext.broadcast(hot), rest


def _with_rest(df: DataFrame, keys: list[str], rest: DataFrame) -> DataFrame:
    return df.join(rest, keys, "left").withColumn("_rest", F.coalesce("_rest", F.array().cast(KNOWN)))


def with_synonyms(
    df: DataFrame, key: str | Sequence[str], words_col: str, lexicon: DataFrame, by_join: bool = False
) -> DataFrame:
    """Adds ``known``: the text's own words found in the lexicon, with their synonyms, ordered by word. A lexicon
    of checked small size goes to the texts, which then need not move at all; for a larger one, or with ``by_join``, the
    texts' words go to the lexicon."""
    keys = [key] if isinstance(key, str) else list(key)
    lexicon = merge_words(lexicon)
    own = settle(df, "_own", F.array_distinct(words_col))
    if not by_join and (shared := dictionary(lexicon)) is not None:
        return own.withColumn("known", _known_from_dictionary(F.col("_own"), shared)).drop("_own")
    hot, rest = _known_from_join(own, keys, lexicon)
    here = _with_rest(own.withColumn("_hot", _known_from_dictionary(F.col("_own"), hot)).drop("_own"), keys, rest)
    return here.withColumn("known", F.sort_array(F.concat("_hot", "_rest"))).drop("_hot", "_rest")


def _edited(clean: Column, op: Column, key: Column, rest: Column | None, shared, alphas: dict[str, float], seed) -> Column:
    """Cleaned texts after the operation named in ``op``, in one Arrow call where the texts are; any other name leaves the
    words as they are. ``rest`` holds what a text knows besides the dictionary."""

    @F.arrow_udf("string")
    def edit(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        synonyms = shared.value
        for clean, op, key, rest in parts(batches):
            done = []
            for text, o, k, more in zip(clean, op, key, rest):
                own = synonyms
                if more:
                    own = {r["word"]: r["synonyms"] for r in more}
                    own |= {w: synonyms[w] for w in set((text or "").split()) if w in synonyms}
                tokens = (text or "").split()
                done.append(" ".join(_edit_words(tokens, o, own, alphas, seed, k)))
            yield pa.array(done, pa.string())

    return edit(clean, op, key, F.lit(None).cast(KNOWN) if rest is None else rest)


def replace_synonyms(
    df: DataFrame, column: str, key: str | Sequence[str], lexicon: DataFrame, share: float = 0.1, seed=42,
    by_join: bool = False, out: str = "replaced",
) -> DataFrame:
    """Adds the cleaned text of a column with synonyms for up to the given share of its words (one at least), every
    occurrence alike: ``synonym_replace`` in one Arrow call, without a column of the synonyms of all words."""
    keys, alphas = [key] if isinstance(key, str) else list(key), rates(synonym=share)
    lexicon, ready = merge_words(lexicon), settle(df, "_clean", clean_chars(F.coalesce(F.col(column), F.lit(""))))
    shared = None if by_join else dictionary(lexicon)
    rest = None
    if shared is None:
        own = settle(ready.select(*keys, "_clean"), "_own", F.array_distinct(words(F.col("_clean"))))
        shared, known = _known_from_join(own, keys, lexicon)
        ready, rest = _with_rest(ready, keys, known), F.col("_rest")
    done = _edited(F.col("_clean"), F.lit("synonym"), _key_text(key_columns(key)), rest, shared, alphas, seed)
    return ready.withColumn(out, done).drop("_clean", "_rest")


def edits(n_words: Column, alpha: float) -> Column:
    """At least one edit, else the given share of the words."""
    return F.greatest(F.lit(1), F.floor(n_words * F.lit(float(alpha))).cast("int"))


def synonym_replace(words_col: Column, known: Column, n: Column, seed, *key) -> Column:
    """Every occurrence of up to n distinct words becomes one of the word's synonyms. Which words: the first n
    in seeded order among those that are no stop words and have synonyms."""
    candidates = F.filter(known, lambda k: ~k["word"].isin(STOP_WORDS))
    ordered = F.array_sort(
        F.transform(
            candidates,
            lambda k: F.struct(
                hash_hex(seed, "synonym", *key, k["word"]).alias("h"),
                k["word"].alias("word"),
                F.element_at(
                    k["synonyms"], index_below(F.size(k["synonyms"]), seed, "which", *key, k["word"]) + 1
                ).alias("synonym"),
            ),
        )
    )
    mapping = F.map_from_entries(
        F.transform(F.slice(ordered, F.lit(1), n), lambda c: F.struct(c["word"], c["synonym"]))
    )
    replaced = let(mapping, lambda m: F.transform(words_col, lambda w: F.coalesce(F.try_element_at(m, w), w)))
    return F.split(F.array_join(replaced, " "), " ")


def random_delete(words_col: Column, p: float, seed, *key) -> Column:
    """Each word stays when its draw is above p; a single word stays, and of a text that would vanish one
    random word remains."""
    kept = F.filter(words_col, lambda w, i: above(p, seed, "delete", *key, i))
    last = F.array(
        F.get(words_col, index_below(F.greatest(F.size(words_col), F.lit(1)), seed, "keep", *key))
    )
    return _first_non_empty(words_col, kept, last)


def _first_non_empty(words_col: Column, kept: Column, fallback: Column) -> Column:
    options = F.filter(F.array(kept, fallback), lambda a: F.size(a) > 0)
    return F.when(F.size(words_col) <= 1, words_col).otherwise(F.get(options, F.lit(0)))


def _draws(seed, *parts):
    """The worker-side twin of rng.u32 for draws that differ in their last part, of which it is a function."""
    start = hashlib.md5(":".join(map(str, (seed, *parts, ""))).encode("utf-8"))

    def draw(last) -> int:
        h = start.copy()
        h.update(str(last).encode("utf-8"))
        return int.from_bytes(h.digest()[:4], "big")

    return draw


def _swap_words(tokens: list[str], n: int, seed, key: str) -> list[str]:
    size, first, other = len(tokens), _draws(seed, "swap", key), _draws(seed, "with", key)
    for step in range(n):
        i = first(step) % size
        tries = (other(f"{step}:{t}") % size for t in range(SWAP_TRIES))
        j = next((j for j in tries if j != i), i)
        tokens[i], tokens[j] = tokens[j], tokens[i]
    return tokens


def _insert_words(tokens: list[str], synonym_of: dict[str, str], n: int, seed, key: str) -> list[str]:
    draw, place = _draws(seed, "insert", key), _draws(seed, "at", key)
    for step in range(n if synonym_of else 0):
        tries = (tokens[draw(f"{step}:{t}") % len(tokens)] for t in range(INSERT_TRIES))
        new = next((synonym_of[w] for w in tries if w in synonym_of), None)
        if new is not None:
            tokens.insert(place(step) % len(tokens), new)
    return tokens


def _ordered_edits(seed):
    """Insertions and swaps build on each other, so they run word by word in Python, one text at a time."""

    @F.arrow_udf("array<string>")
    def edit(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def one(op, tokens, known, synonym, n, key):
            if not tokens:
                return tokens
            if op == "swap":
                return _swap_words(tokens, int(n), seed, key)
            return _insert_words(tokens, dict(zip(known or (), synonym or ())), int(n), seed, key)

        for part in parts(batches):
            yield pa.array([one(*row) for row in zip(*part)], pa.list_(pa.string()))

    return edit


def _key_text(key) -> Column:
    return F.concat_ws(":", *[c.cast("string") for c in key])


def random_swap(words_col: Column, n: Column, seed, *key) -> Column:
    """n times two random positions trade places; a pair that stays equal for three draws is skipped."""
    none = F.array().cast("array<string>")
    return _ordered_edits(seed)(F.lit("swap"), words_col, none, none, n, _key_text(key))


def random_insert(words_col: Column, known: Column, n: Column, seed, *key) -> Column:
    """n times the first synonym of a random word (nine tries to find one that has synonyms) goes to a random place."""
    return _ordered_edits(seed)(F.lit("insert"), words_col, *_first_synonyms(known), n, _key_text(key))


def _first_synonyms(known: Column) -> tuple[Column, Column]:
    return (
        F.transform(known, lambda k: k["word"]),
        F.transform(known, lambda k: F.get(k["synonyms"], F.lit(0))),
    )


def rates(synonym: float = 0.1, insert: float = 0.1, swap: float = 0.1, delete: float = 0.1) -> dict[str, float]:
    return {"synonym": synonym, "insert": insert, "swap": swap, "delete": delete}


def apply_operation(op: Column, rep: Column, words_col: Column, known: Column, alphas: dict[str, float], seed, *key) -> Column:
    """The cleaned text after the operation named in ``op``; any other name leaves the words as they are."""
    ident = (*key, rep)
    size = F.size(words_col)
    in_order = op.isin("insert", "swap")
    n = F.when(op == "insert", edits(size, alphas["insert"])).otherwise(edits(size, alphas["swap"]))
    moved = _ordered_edits(seed)(
        op, F.when(in_order, words_col), *_first_synonyms(F.when(op == "insert", known)), n, _key_text(ident)
    )
    result = (
        F.when(op == "synonym", synonym_replace(words_col, known, edits(size, alphas["synonym"]), seed, *ident))
        .when(op == "delete", random_delete(words_col, alphas["delete"], seed, *ident))
        .when(in_order, moved)
        .otherwise(words_col)
    )
    return clean_chars(F.array_join(result, " "))


def chosen_operations(num_aug: float, alphas: dict[str, float], seed, *key) -> Column:
    """``array<struct<op, rep>>``: of int(num_aug / 4) + 1 candidates per enabled operation, the num_aug that
    come first in seeded order (below 1: each candidate with an even share of that probability)."""
    enabled = [op for op in OPERATIONS if alphas[op] > 0]
    per_op = int(num_aug / 4) + 1
    pairs = [F.struct(F.lit(op).alias("op"), F.lit(r).alias("rep")) for op in enabled for r in range(per_op)]
    if not pairs:
        return F.array().cast("array<struct<op:string,rep:int>>")
    ranked = F.array_sort(
        F.transform(
            F.array(*pairs),
            lambda c: F.struct(
                hash_hex(seed, "pick", *key, c["op"], c["rep"]).alias("h"), c["op"].alias("op"), c["rep"].alias("rep")
            ),
        )
    )
    if num_aug >= 1:
        picked = F.slice(ranked, 1, int(num_aug))
    else:
        share = num_aug / len(pairs)
        picked = F.filter(ranked, lambda c: uniform(seed, "keep", *key, c["op"], c["rep"]) < F.lit(share))
    return F.transform(picked, lambda c: F.struct(c["op"].alias("op"), c["rep"].alias("rep")))


def eda_explode(
    df: DataFrame,
    column: str,
    key: str | Sequence[str],
    lexicon: DataFrame,
    num_aug: float = 9,
    alphas: dict[str, float] | None = None,
    seed=42,
) -> DataFrame:
    """One row per augmented text plus the cleaned original (``op`` = original) as the last of each group.
    Adds ``candidate``, ``op`` and ``augmented``. Texts without a letter yield no rows."""
    alphas = alphas or rates()
    keys = key_columns(key)
    base = df.withColumn("_words", words(clean_chars(F.col(column)))).filter(F.size("_words") > 0)
    known = with_synonyms(base, key, "_words", lexicon)
    original = F.array(F.struct(F.lit("original").alias("op"), F.lit(0).alias("rep")))
    plans = F.concat(chosen_operations(num_aug, alphas, seed, *keys), original)
    return (
        known.select("*", F.posexplode(plans).alias("candidate", "_plan"))
        .withColumn("op", F.col("_plan.op"))
        .withColumn(
            "augmented",
            apply_operation(F.col("op"), F.col("_plan.rep"), F.col("_words"), F.col("known"), alphas, seed, *keys),
        )
        .drop("_words", "known", "_plan")
    )


def with_plan(df: DataFrame, alphas: dict[str, float], seed, *key) -> DataFrame:
    """Adds ``_plan``, the one operation a text gets. It is settled first, because the edits read it per word."""
    plan = F.get(chosen_operations(1, alphas, seed, *key), F.lit(0))
    none = F.struct(F.lit("none").alias("op"), F.lit(0).alias("rep"))
    return settle(df, "_plan", F.coalesce(plan, none))


def eda_text(text: Column, words_col: Column, known: Column, alphas: dict[str, float], seed, *key) -> Column:
    """The text after the operation in ``_plan``; texts without a letter, or without a plan, stay as they are."""
    plan = F.col("_plan")
    changed = apply_operation(plan["op"], plan["rep"], words_col, known, alphas, seed, *key)
    return F.when((F.size(words_col) == 0) | (plan["op"] == "none"), text).otherwise(changed)


def eda_one(
    df: DataFrame,
    column: str,
    key: str | Sequence[str],
    lexicon: DataFrame,
    alphas: dict[str, float] | None = None,
    seed=42,
    out: str = "augmented",
) -> DataFrame:
    """Adds one augmented version of every text."""
    keys, alphas = key_columns(key), alphas or rates()
    if (shared := dictionary(merge_words(lexicon))) is not None:
        ready = with_plan(settle(df, "_clean", clean_chars(F.coalesce(F.col(column), F.lit("")))), alphas, seed, *keys)
        plan = F.col("_plan")
        done = _edited(F.col("_clean"), plan["op"], _key_text((*keys, plan["rep"])), None, shared, alphas, seed)
        as_is = (F.trim("_clean") == "") | (plan["op"] == "none")
        return ready.withColumn(out, F.when(as_is, F.col(column)).otherwise(clean_chars(done))).drop("_clean", "_plan")
    base = df.withColumn("_words", words(clean_chars(F.coalesce(F.col(column), F.lit("")))))
    known = with_plan(with_synonyms(base, key, "_words", lexicon), alphas, seed, *keys)
    changed = eda_text(F.col(column), F.col("_words"), F.col("known"), alphas, seed, *keys)
    return known.withColumn(out, changed).drop("_words", "known", "_plan")


# ---- the same edits for many texts of one row, inside a task ---------------------------------------------


def _hex(seed, *parts) -> str:
    return hashlib.md5(":".join(map(str, (seed, *parts))).encode("utf-8")).hexdigest()


def order_text(seed, key: str, name: str) -> str:
    """What a row's methods are ordered by."""
    return _hex(seed, "method", key, name)


def _clean(text: str) -> str:
    letters = re.sub("[^a-z ]", " ", re.sub("[’']", "", text).lower())
    return re.sub("^ ", "", re.sub(" +", " ", letters))


_STOP_SET = frozenset(STOP_WORDS)


def _replace_words(tokens: list[str], synonyms: dict, n: int, seed, key: str) -> list[str]:
    which, candidates = _draws(seed, "which", key), []
    order = hashlib.md5(f"{seed}:synonym:{key}:".encode())
    for w in {w for w in tokens if w in synonyms} - _STOP_SET:
        h = order.copy()
        h.update(w.encode())
        candidates.append((h.digest(), w))
    chosen = {w: synonyms[w][which(w) % len(synonyms[w])] for _, w in heapq.nsmallest(n, candidates) if synonyms[w]}
    return [chosen.get(w, w) for w in tokens]


def _delete_words(tokens: list[str], p: float, seed, key: str) -> list[str]:
    limit, draw = int(p * 2**32), _draws(seed, "delete", key)
    if len(tokens) <= 1:
        return tokens
    kept = [w for i, w in enumerate(tokens) if limit < 2**32 and draw(i) > limit]
    return kept or [tokens[_draws(seed, "keep")(key) % len(tokens)]]


def _edit_words(tokens: list[str], op: str, synonyms: dict, alphas: dict[str, float], seed, key: str) -> list[str]:
    """One operation on the words of a text. ``synonyms`` may hold words the text has not."""
    if not tokens or op not in OPERATIONS:
        return tokens
    n = max(1, int(len(tokens) * alphas[op]))
    if op == "synonym":
        return _replace_words(tokens, synonyms, n, seed, key)
    if op == "delete":
        return _delete_words(tokens, alphas["delete"], seed, key)
    if op == "swap":
        return _swap_words(tokens, n, seed, key)
    return _insert_words(tokens, {w: next(iter(synonyms[w]), None) for w in set(tokens) if w in synonyms}, n, seed, key)


def edit_text(text: str | None, synonyms: dict, alphas: dict[str, float], seed, key: str) -> str | None:
    """The worker-side twin of ``eda_text``: one operation, chosen by the key. ``synonyms`` may hold words the text
    has not."""
    tokens = [] if text is None else [w for w in _clean(text).split(" ") if w]
    enabled = [op for op in OPERATIONS if alphas[op] > 0]
    if not tokens or not enabled:
        return text
    op = min(enabled, key=lambda o: (_hex(seed, "pick", key, o, 0), o))
    return _clean(" ".join(_edit_words(tokens, op, synonyms, alphas, seed, f"{key}:0")))


def dictionary(lexicon: DataFrame):
    """A merged lexicon of checked small size as a broadcast dictionary, or None for a larger one."""
    if not _is_small(lexicon):
        return None
    return lexicon.sparkSession.sparkContext.broadcast({r["word"]: list(r["synonyms"]) for r in lexicon.collect()})
