"""One query per operator, over its whole table, with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import chat, exact_dedup, html_text, language, line_dedup, mixing, phrases, pieces, quality, simhash, substring_dedup, superminhash, whitening
from freshet.llm.common import WORD, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name; ``sql`` is its check."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_sentencepiece")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded, _ = pieces.codec_columns(docs, pieces.load())
    coded = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), encoded().alias("coded"))
    return coded.select(
        "doc_id", F.size("coded.ids").cast("long").alias("n_ids"), "coded.ids",
        F.sha2("coded.back", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"),
    )


@query("op2_simhash")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
POLICY = "v1"


@query(
    "op3_substring_dedup",
    f"""WITH split AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    windows AS (SELECT doc_id, k, array_to_string(words[k:k + 12], ' ') AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM split)),
    again AS (SELECT doc_id, k FROM windows JOIN (SELECT w, min(doc_id) AS owner FROM windows GROUP BY w) USING (w)
        WHERE owner < doc_id),
    gone AS (SELECT DISTINCT doc_id, k + j AS pos FROM again, range(13) t(j)),
    placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
    judged AS (SELECT placed.*, gone.pos IS NOT NULL AS removed FROM placed LEFT JOIN gone USING (doc_id, pos)),
    counted AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
        string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed) AS kept FROM judged GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN counted USING (doc_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_MEASURED = f"""WITH split AS (SELECT doc_id, text, {_WORDS} AS words, string_split(coalesce(text, ''), chr(10)) AS all_lines,
        row_number() OVER () AS r FROM documents),
    lined AS (SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '{WORD}')) AS lines FROM split),
    windows AS (SELECT r, unnest(range(1, len(words) - 1)) AS k, words FROM split),
    named AS (SELECT r, k, words[k:k + 2] AS w FROM windows),
    again AS (SELECT r, k FROM named QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
    covered AS (SELECT r, count(DISTINCT k + j) AS n FROM again, range(3) t(j) GROUP BY r),
    measured AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
        FROM lined LEFT JOIN covered USING (r))"""
#: The rules once more, in SQL.
_RULE_SQL = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
_FAILED = " + ".join(f"CASE WHEN {rule} THEN {quality.BIT[name]} ELSE 0 END" for name, rule in _RULE_SQL.items())


def _policy_fails(policy: str) -> str:
    return "(" + " OR ".join(_RULE_SQL[rule] for rule in quality.POLICIES[policy]) + ")"


@query(
    "op4_quality",
    f"""{_MEASURED}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_policy_fails("base")} AS base_failed,
        NOT {_policy_fails(POLICY)} AS kept, ({_FAILED})::BIGINT AS failed, NOT {_policy_fails("v2")} AS kept_v2 FROM measured""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = written(quality.ledger(table(spark, sf_dir, "documents")))
    return book.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails("base").alias("base_failed"), (~quality.fails(POLICY)).alias("kept"), "failed", (~quality.fails("v2")).alias("kept_v2"),
    )


_CASES = ", ".join(
    f"('{policy}', '{rule}', {quality.policy_mask(rules)}, {quality.BIT[rule]})" for policy, rules in quality.POLICIES.items() for rule in rules
)


@query(
    "quality_ablations",
    f"""{_MEASURED},
    book AS (SELECT {_FAILED} AS failed FROM measured)
    SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (failed & mask <> 0) AS n_dropped,
        count(*) FILTER (failed & mask & ~bit <> 0) AS n_without, count(*) FILTER (failed & mask = bit) AS n_only
    FROM book, (VALUES {_CASES}) c(policy, rule, mask, bit) GROUP BY policy, rule""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the ledger of all documents."""
    return quality.ablations(written(quality.ledger(table(spark, sf_dir, "documents"))))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op5_exact_dedup",
    f"""WITH marked AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_UPPER}, {_LOWER})) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
    FROM marked WINDOW same AS (PARTITION BY text_sha256)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha256")).alias("text_sha256")
    )


@query(
    "op7_line_dedup",
    f"""WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_UPPER}, {_LOWER}) AS key FROM lines),
    owned AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    judged AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN owned USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), stats="lines")
    return kept.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


#: The mixture: domains are thirds of the sources by number; weights of what is not named are 1.
DOMAIN = "concat('d', coalesce(try_cast(regexp_extract(source, '[0-9]+', 0) AS INT), 0) % 3)"
DOMAIN_WEIGHTS, LANG_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}, {"en": 6, "fr": 2, "de": 2}
TOKEN_PERCENT, MAX_EPOCHS = 90, 2


def mixed(docs: DataFrame, max_epochs: int) -> DataFrame:
    """The mixture of the queries and the pipeline."""
    return mixing.mix(
        docs,
        {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")},
        {
            "domain": mixing.weight_of("domain", DOMAIN_WEIGHTS),
            "lang": mixing.weight_of("lang", LANG_WEIGHTS),
            "source": mixing.weight_of("source", {}),
        },
        F.expr(f"total * {TOKEN_PERCENT} div 100"),
        max_epochs,
    )


def _dealt(name: str, above: str, parents: str, child: str, weights: dict[str, int]) -> str:
    """SQL of one level: ``name`` has the nodes of the level with their budgets."""
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in weights.items())
    weight = f"CASE {child} {cases} ELSE 1 END" if cases else "1"
    keys = ", ".join(k for k in (parents, child) if k)
    family = f"PARTITION BY {parents}" if parents else ""
    parent = f"JOIN {above} USING ({parents})" if parents else f"CROSS JOIN {above}"
    return f"""{name}_n AS (SELECT {keys}, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS capacity, ({weight})::HUGEINT AS weight
        FROM leaves GROUP BY ALL),
    {name}_s AS (SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
            (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weight_left
        FROM {name}_n {parent} WINDOW o AS ({family} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child})),
    {name}_f AS (SELECT *, before * weight + capacity * weight_left <= budget * weight AS fills FROM {name}_s),
    {name} AS (SELECT {keys}, CASE WHEN fills THEN capacity ELSE
            ((budget - coalesce(sum(capacity) FILTER (fills) OVER ({family}), 0))::HUGEINT * weight)
                // (sum(weight) FILTER (NOT fills) OVER ({family}))::HUGEINT END::HUGEINT AS budget FROM {name}_f)"""


_MIX_SQL = f"""WITH items AS (SELECT doc_id,
        'd' || (coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INT), 0) % 3) AS domain,
        coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM items GROUP BY ALL),
    root AS (SELECT (sum(tokens) * {TOKEN_PERCENT}) // 100 AS budget FROM leaves),
    {_dealt("domains", "root", "", "domain", DOMAIN_WEIGHTS)},
    {_dealt("langs", "domains", "domain", "lang", LANG_WEIGHTS)},
    {_dealt("sources", "langs", "domain, lang", "source", {})},
    plan AS (SELECT domain, lang, source, tokens AS leaf_tokens,
        CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget FROM leaves JOIN sources USING (domain, lang, source)),
    placed AS (SELECT *, budget - whole * leaf_tokens AS rest,
        md5('{mixing.SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS place
        FROM items JOIN plan USING (domain, lang, source)),
    summed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
    SELECT doc_id, domain, lang, source, tokens AS n_tokens, unnest(range(times))::INT AS epoch
    FROM (SELECT *, (whole + (rest > 0 AND before < rest)::INT)::BIGINT AS times FROM summed)"""


@query("op8_mixing", _MIX_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs, MAX_EPOCHS).select("row.doc_id", "domain", "lang", "source", "n_tokens", "epoch")


_SAID = f"""'{chat.START}' || coalesce(role, '') || chr(10)
    || replace(replace(coalesce(text, ''), '{chat.START}', '< |im_start|>'), '{chat.STOP}', '< |im_end|>') || '{chat.STOP}' || chr(10)"""


@query(
    "op6_chat_format",
    f"""WITH turns AS (SELECT DISTINCT * FROM conversations),
    logged AS (SELECT conv_id, list([role, text] ORDER BY turn) AS said, string_agg({_SAID}, '' ORDER BY turn) AS chat
        FROM turns GROUP BY conv_id),
    prefixes AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, len(said))) AS k FROM logged)),
    kept AS (SELECT logged.* FROM logged ANTI JOIN prefixes USING (said))
    SELECT min(conv_id) AS conv_id, 0 AS part, len(said) AS n_turns, count(*) AS n_logged, any_value(chat) AS chat
    FROM kept GROUP BY said""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(table(spark, sf_dir, "conversations"))
    return chats.withColumnRenamed("conv", "conv_id")


@query("op9_html_text")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extracted("html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_language_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = docs.select("doc_id", language.held_out().alias("held_out"), language.predicted(language.train(docs)).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), "told.score")


@query(
    "op11_phrases",
    f"""WITH pieces AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
    spans AS (SELECT lang, array_to_string(words[k:k + w - 1], ' ') AS phrase, w FROM (
        SELECT lang, words, w, unnest(range(1, len(words) - w + 2)) AS k FROM split, range(1, {phrases.LONGEST + 1}) t(w))),
    counts AS (SELECT lang, phrase, w, count(*)::HUGEINT AS f FROM spans GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE w = 1 GROUP BY lang),
    candidates AS (SELECT lang, phrase, w, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE w > 1 AND f >= {phrases.MIN_COUNT}),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(words[:k], ' ') AS lp, array_to_string(words[k + 1:], ' ') AS rp
        FROM (SELECT *, unnest(range(1, w)) AS k FROM candidates)),
    scored AS (SELECT cuts.*, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score FROM cuts
        JOIN counts l ON l.lang = cuts.lang AND l.phrase = lp JOIN counts r ON r.lang = cuts.lang AND r.phrase = rp),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, array_to_string(words[k:k + v - 1], ' ') AS phrase, max(a) AS around FROM (
        SELECT *, unnest(range(1, w - v + 2)) AS k FROM candidates, range(2, {phrases.LONGEST}) t(v) WHERE v < w) GROUP BY ALL),
    kept AS (SELECT weakest.* FROM weakest LEFT JOIN inside USING (lang, phrase)
        WHERE around IS NULL OR 100 * around < {phrases.COVERED} * a),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM placed JOIN totals USING (lang) WHERE rank <= {phrases.TOP}""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


_SHINGLES = f"""WITH split AS (SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '{WORD}') AS words FROM documents),
    shingles AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[]
        WHEN len(words) < {superminhash.SHINGLE} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {superminhash.SHINGLE - 2}), lambda k: array_to_string(words[k:k + {superminhash.SHINGLE - 1}], ' ')) END)) AS held
        FROM split)"""


@query(
    "op12_superminhash",
    f"""{_SHINGLES.replace("WITH", "WITH RECURSIVE", 1)},
    sets AS (SELECT held, md5(array_to_string(held, chr(10))) AS s, len(held) AS n, min(doc_id) AS least FROM shingles WHERE len(held) > 0 GROUP BY held),
    elements AS (SELECT s, n, unnest(held) AS e FROM sets),
    pairs AS (SELECT a.s, b.s AS t FROM elements a JOIN elements b ON a.e = b.e AND a.s <> b.s AND 100 * a.n >= {superminhash.PERCENT} * b.n AND 100 * b.n >= {superminhash.PERCENT} * a.n
        GROUP BY a.s, b.s, a.n, b.n HAVING 100 * count(*) >= {superminhash.PERCENT} * (a.n + b.n - count(*))),
    reached AS (SELECT s, s AS t FROM sets UNION SELECT reached.s, pairs.t FROM reached JOIN pairs ON reached.t = pairs.s),
    named AS (SELECT reached.s, min(least) AS component_id FROM reached JOIN sets ON reached.t = sets.s GROUP BY reached.s)
    SELECT doc_id, len(shingles.held)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
        doc_id = coalesce(component_id, doc_id) AS kept
    FROM shingles LEFT JOIN sets ON shingles.held = sets.held LEFT JOIN named USING (s)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


@query("op13_whitening")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    return whitening.whitened(vectors, model).select(
        F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(whitening.identity_error(vectors, model)).alias("identity_error"),
    )
