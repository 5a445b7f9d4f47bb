"""Catalogue: text functions and tokenising jobs (P3, P4, F15-F24, T1-T4, J11,
J12, U4, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.functions import text as TX
from labelloop.operators import tokenize as TK
from labelloop.plans import fixtures as fx
from labelloop.plans.registry import register
from labelloop.session import stored

MAX_LEN = 128
SENTENCE_TEMPLATE = "Given a movie review: '{}'"

_SPECIALS_SQL = ", ".join(f"('{t}', {i}, 0::BIGINT)" for i, t in enumerate(TX.SPECIAL_TOKENS))


def sql_norm(src: str, lower: bool = False) -> str:
    t = (f"strip_accents(replace(replace(trim(regexp_replace(text, '{TX.WS_RE2}', ' ', 'g')), "
         f"'``', '\"'), '''''', '\"'))")
    if lower:
        t = f"lower({t})"
    return f"norm AS (SELECT id, {t} AS t FROM {src})"


SQL_PIECES = """pc AS (SELECT id, flatten(list_transform(
    list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: '▁' || w),
    lambda p: CASE WHEN regexp_matches(p, '\\p{Nd},$') THEN [left(p, length(p) - 1), ','] ELSE [p] END)) AS pieces
  FROM norm)"""

SQL_VOCAB = f"""cnt AS (SELECT token, count(*) AS count FROM (SELECT UNNEST(pieces) AS token FROM pc)
         WHERE token NOT IN ({", ".join(f"'{t}'" for t in TX.SPECIAL_TOKENS)}) GROUP BY token),
ranked AS (SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 + {len(TX.SPECIAL_TOKENS)} AS INTEGER)
                  AS token_id, count FROM cnt),
vocab AS (SELECT col0 AS token, CAST(col1 AS INTEGER) AS token_id, col2 AS count FROM (VALUES {_SPECIALS_SQL})
          UNION ALL SELECT * FROM ranked)"""

W_DOCS = "WITH " + fx.SQL_CORPUS + ",\n" + sql_norm("fx_corpus") + ",\n" + SQL_PIECES
W_VOCAB = W_DOCS + ",\n" + SQL_VOCAB
SQL_LONG_IDS = """,
lp AS (SELECT id, UNNEST(range(0, len(pieces))) AS pos, UNNEST(pieces) AS token FROM pc),
lid AS (SELECT lp.id, lp.pos, lp.token, coalesce(v.token_id, 1) AS token_id FROM lp LEFT JOIN vocab v ON v.token = lp.token)"""


def corpus(spark, sf_dir):
    """Text jobs need (id, text) only: read documents without the label join."""
    return fx.documents_text(spark, sf_dir)


def vocab_of(spark, sf_dir):
    return TK.build_vocab(corpus(spark, sf_dir))


@register("q_clean_text", "WITH " + fx.SQL_CORPUS + """
SELECT id, replace(text, chr(10), '') AS text FROM fx_corpus""")
def q_clean_text(spark, sf_dir):
    """Newline removal before a text goes into a prompt."""
    return corpus(spark, sf_dir).select("id", TX.clean_text("text").alias("text"))


@register("q_prompt_sentence", "WITH " + fx.SQL_CORPUS + """
SELECT id, 'Given a movie review: ''' || replace(text, chr(10), '') || '''' AS sentence FROM fx_corpus""")
def q_prompt_sentence(spark, sf_dir):
    """Cleaned text filled into the sentence template."""
    return corpus(spark, sf_dir).select("id", TX.fill_template(SENTENCE_TEMPLATE, TX.clean_text("text"))
                                        .alias("sentence"))


@register("q_norm_space", "WITH " + fx.SQL_CORPUS + f"""
SELECT id, trim(regexp_replace(text, '{TX.WS_RE2}', ' ', 'g')) AS text FROM fx_corpus""")
def q_norm_space(spark, sf_dir):
    """whitespace collapsed and trimmed."""
    return corpus(spark, sf_dir).select("id", TX.norm_space("text").alias("text"))


@register("q_norm_quotes", "WITH " + fx.SQL_CORPUS + """
SELECT id, replace(replace(text, '``', '"'), '''''', '"') AS text FROM fx_corpus""")
def q_norm_quotes(spark, sf_dir):
    """F16: doubled quote marks normalised."""
    return corpus(spark, sf_dir).select("id", TX.norm_quotes("text").alias("text"))


@register("q_strip_accents", "WITH " + fx.SQL_CORPUS + """
SELECT id, strip_accents(text) AS text FROM fx_corpus""")
def q_strip_accents(spark, sf_dir):
    """NFKD and combining marks removed."""
    return corpus(spark, sf_dir).select("id", TX.strip_accents("text").alias("text"))


@register("q_norm_text", "WITH " + fx.SQL_CORPUS + ",\n" + sql_norm("fx_corpus", lower=True) + """
SELECT id, t AS text FROM norm""")
def q_norm_text(spark, sf_dir):
    """F15-F18 chained, lower-casing on."""
    return corpus(spark, sf_dir).select("id", TX.normalise("text", lower=True).alias("text"))


@register("q_split_digit_comma", W_DOCS + """
SELECT id, array_to_string(pieces, ' ') AS pieces FROM pc""")
def q_split_digit_comma(spark, sf_dir):
    """word pieces with the digit-comma split, joined by spaces."""
    p = TK.pieces(corpus(spark, sf_dir))
    return p.select("id", F.array_join("pieces", " ").alias("pieces"))


@register("q_detokenise", W_DOCS + """
SELECT id, trim(replace(array_to_string(pieces, ''), '▁', ' ')) AS text FROM pc""")
def q_detokenise(spark, sf_dir):
    """pieces joined back to text."""
    p = TK.pieces(corpus(spark, sf_dir))
    return p.select("id", TX.detokenise("pieces").alias("text"))


@register("q_vocab_build", W_VOCAB + """
SELECT token, token_id, count FROM vocab""")
def q_vocab_build(spark, sf_dir):
    """Vocabulary over the whole corpus (specials first, count desc)."""
    return vocab_of(spark, sf_dir)


@register("q_vocab_size", W_VOCAB + """
SELECT count(*) AS vocab_size FROM vocab""")
def q_vocab_size(spark, sf_dir):
    """T4."""
    return TK.vocab_size(vocab_of(spark, sf_dir))


@register("q_token_to_id", W_VOCAB + SQL_LONG_IDS + """
SELECT id, CAST(pos AS BIGINT) AS pos, token_id FROM lid""")
def q_token_to_id(spark, sf_dir):
    """Every piece of every text -> id, [UNK] default (relational form)."""
    p = TK.pieces(corpus(spark, sf_dir)).select("id", "pieces")
    j = TK.token_ids_join(p, vocab_of(spark, sf_dir))
    return j.select("id", F.col("pos").cast("bigint").alias("pos"), "token_id")


SQL_ENC = W_VOCAB + SQL_LONG_IDS + f""",
n AS (SELECT id, least(len(pieces), {MAX_LEN - 2}) AS k FROM pc),
enc AS (
  SELECT id, 0 AS pos, {TX.CLS_ID} AS token_id, 1 AS mask FROM n
  UNION ALL SELECT id, pos + 1, token_id, 1 FROM lid WHERE pos < {MAX_LEN - 2}
  UNION ALL SELECT id, k + 1, {TX.SEP_ID}, 1 FROM n
  UNION ALL SELECT n.id, r.p, {TX.PAD_ID}, 0 FROM n CROSS JOIN range(0, {MAX_LEN}) r(p) WHERE r.p > n.k + 1)"""


@register("q_encode_corpus", SQL_ENC + """
SELECT id, CAST(pos AS BIGINT) AS pos, CAST(token_id AS INTEGER) AS token_id, CAST(mask AS INTEGER) AS mask FROM enc""")
def q_encode_corpus(spark, sf_dir):
    """T2 (+F21, F22): model inputs of every text, exploded (id, pos, token_id, mask)."""
    enc = TK.encode(corpus(spark, sf_dir), vocab_of(spark, sf_dir), max_length=MAX_LEN)
    z = enc.select("id", F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "z"))
    return z.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("z.input_ids").alias("token_id"),
                    F.col("z.attention_mask").alias("mask"))


@register("q_pad_truncate", SQL_ENC + """
SELECT id, CAST(sum(mask) AS BIGINT) AS n_real, CAST(count(*) AS BIGINT) AS n_pos FROM enc GROUP BY id""")
def q_pad_truncate(spark, sf_dir):
    """real and padded positions per text after truncate / pad to 128."""
    enc = TK.encode(corpus(spark, sf_dir), vocab_of(spark, sf_dir), max_length=MAX_LEN)
    return enc.select("id", F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_real"),
                      F.size("input_ids").cast("bigint").alias("n_pos"))


@register("q_decode_corpus", W_VOCAB + SQL_LONG_IDS + f"""
SELECT d.id, trim(replace(coalesce(string_agg(v.token, '' ORDER BY l.pos), ''), '▁', ' ')) AS text
FROM pc d LEFT JOIN lid l ON l.id = d.id AND l.token_id >= {len(TX.SPECIAL_TOKENS)}
LEFT JOIN vocab v ON v.token_id = l.token_id GROUP BY d.id""")
def q_decode_corpus(spark, sf_dir):
    """The encoded whole texts back to text (special ids dropped)."""
    vocab = vocab_of(spark, sf_dir)
    return TK.decode(TK.encode(corpus(spark, sf_dir), vocab, max_length=None), vocab)


@register("q_id_to_token", W_VOCAB + SQL_LONG_IDS + f""",
whole AS (SELECT id, 0 AS pos, {TX.CLS_ID} AS token_id FROM pc UNION ALL SELECT id, pos + 1, token_id FROM lid
          UNION ALL SELECT id, len(pieces) + 1, {TX.SEP_ID} FROM pc)
SELECT w.id, CAST(w.pos AS BIGINT) AS pos, v.token FROM whole w JOIN vocab v ON v.token_id = w.token_id""")
def q_id_to_token(spark, sf_dir):
    """Id -> token for every position of the encoded whole texts."""
    vocab = vocab_of(spark, sf_dir)
    enc = stored(TK.encode(corpus(spark, sf_dir), vocab, max_length=None).select("id", "input_ids"), "encoded")
    long = enc.select("id", F.posexplode("input_ids").alias("pos", "token_id")).select("id", F.col("pos").cast("bigint").alias("pos"), "token_id")
    return TK.id_to_token(long, vocab).select("id", "pos", "token")


# Vocabulary of the held-out benchmark texts added on top of the corpus
# vocabulary; an added token takes the new id.
SQL_MERGE = W_VOCAB + """,
bn AS (SELECT item_id AS id, text FROM benchmark),
bnorm AS (SELECT id, strip_accents(replace(replace(trim(regexp_replace(text, '""" + TX.WS_RE2 + """', ' ', 'g')),
          '``', '"'), '''''', '"')) AS t FROM bn),
bpc AS (SELECT id, flatten(list_transform(
    list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: '▁' || w),
    lambda p: CASE WHEN regexp_matches(p, '\\p{Nd},$') THEN [left(p, length(p) - 1), ','] ELSE [p] END)) AS pieces
  FROM bnorm),
bcnt AS (SELECT token, count(*) AS count FROM (SELECT UNNEST(pieces) AS token FROM bpc) GROUP BY token),
added AS (SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 + (SELECT count(*) FROM vocab) AS INTEGER)
          AS token_id FROM bcnt),
merged AS (SELECT token, token_id FROM added
           UNION ALL SELECT token, token_id FROM vocab WHERE token NOT IN (SELECT token FROM added))"""


def merged_vocab(spark, sf_dir):
    from labelloop.sources.tables import numbered
    base = vocab_of(spark, sf_dir)
    bench = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    cnt = (TK.pieces(bench).select(F.explode("pieces").alias("token"))
           .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    added = numbered(cnt.orderBy(F.col("count").desc(), "token"), "token_id", base.count(), "added-vocab")
    return TK.vocab_merge(base, added.withColumn("token_id", F.col("token_id").cast("int")))


@register("q_vocab_merge", SQL_MERGE + """
SELECT token, token_id FROM merged""")
def q_vocab_merge(spark, sf_dir):
    """U4: corpus vocabulary merged with benchmark pieces (added ones win)."""
    return merged_vocab(spark, sf_dir)


@register("q_vocab_gaps", SQL_MERGE + """
SELECT token, token_id, CAST(expected AS INTEGER) AS expected FROM (
  SELECT token, token_id, coalesce(lag(token_id) OVER (ORDER BY token_id) + 1, 0) AS expected FROM merged)
WHERE token_id <> expected""")
def q_vocab_gaps(spark, sf_dir):
    """Ids that break the consecutive order after the merge."""
    return TK.vocab_gaps(merged_vocab(spark, sf_dir)).select(
        "token", "token_id", F.col("expected").cast("int").alias("expected"))


# F22-F24 on sequence pairs: consecutive turns of a conversation
SQL_PAIRS = W_VOCAB + """,
cv AS (SELECT conv_id, turn, text, [conv_id, turn] AS id FROM conversations),
cnorm AS (SELECT id, strip_accents(replace(replace(trim(regexp_replace(text, '""" + TX.WS_RE2 + """', ' ', 'g')),
          '``', '"'), '''''', '"')) AS t FROM cv),
cpc AS (SELECT id, flatten(list_transform(
    list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: '▁' || w),
    lambda p: CASE WHEN regexp_matches(p, '\\p{Nd},$') THEN [left(p, length(p) - 1), ','] ELSE [p] END)) AS pieces
  FROM cnorm),
cids AS (SELECT cpc.id, list_transform(pieces, lambda p: 0) AS z, len(pieces) AS n FROM cpc),
pairs AS (SELECT a.conv_id, a.turn, ia.n AS na, ib.n AS nb
          FROM cv a JOIN cv b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
          JOIN cids ia ON ia.id = a.id JOIN cids ib ON ib.id = b.id)"""


def _pairs(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    p = TK.pieces(conv.withColumn("id", F.struct("conv_id", "turn")))
    enc = TK.token_ids_join(p.select("id", "pieces"), vocab_of(spark, sf_dir))
    from labelloop.operators.retrieve import collect_ordered
    ids = collect_ordered(enc, "id", "pos", "token_id", "ids")
    p = p.join(ids, "id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    a = p.select("conv_id", "turn", F.col("ids").alias("a"))
    b = p.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("b"))
    return a.join(b, ["conv_id", "turn"])


# every position of [CLS] a [SEP] b [SEP]
SQL_PAIR_IDS = SQL_PAIRS + f""",
cl AS (SELECT id, UNNEST(range(0, len(pieces))) AS pos, UNNEST(pieces) AS token FROM cpc),
clid AS (SELECT cl.id, cl.pos, coalesce(v.token_id, {TX.UNK_ID}) AS token_id FROM cl LEFT JOIN vocab v ON v.token = cl.token),
joined AS (
  SELECT conv_id, turn, 0 AS pos, {TX.CLS_ID} AS token_id, 1 AS special FROM pairs
  UNION ALL SELECT p.conv_id, p.turn, 1 + c.pos, c.token_id, 0 FROM pairs p JOIN clid c ON c.id = [p.conv_id, p.turn]
  UNION ALL SELECT conv_id, turn, na + 1, {TX.SEP_ID}, 1 FROM pairs
  UNION ALL SELECT p.conv_id, p.turn, p.na + 2 + c.pos, c.token_id, 0 FROM pairs p JOIN clid c ON c.id = [p.conv_id, p.turn + 1]
  UNION ALL SELECT conv_id, turn, na + nb + 2, {TX.SEP_ID}, 1 FROM pairs)"""


@register("q_special_tokens", SQL_PAIR_IDS + """
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CAST(token_id AS INTEGER) AS token_id FROM joined""")
def q_special_tokens(spark, sf_dir):
    """[CLS] a [SEP] b [SEP] for consecutive turns, position by position."""
    s = _pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(TX.with_special_tokens("a", "b")).alias("pos", "token_id"))
    return s.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "token_id")


@register("q_special_mask", SQL_PAIR_IDS + f"""
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, special AS mask, CASE WHEN token_id IN ({TX.CLS_ID}, {TX.SEP_ID}) THEN 1 ELSE 0 END AS formatted
FROM joined""")
def q_special_mask(spark, sf_dir):
    """special-token mask of the pair form, position by position, made from the two
    sequences and, ``formatted``, from the sequence that already has its special tokens."""
    both = F.arrays_zip(TX.special_tokens_mask("a", "b").alias("mask"),
                        TX.special_tokens_mask(TX.with_special_tokens("a", "b"), already_formatted=True).alias("formatted"))
    s = _pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(both).alias("pos", "m"))
    return s.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.mask", "m.formatted")


@register("q_segment_ids", SQL_PAIRS + """
SELECT conv_id, turn, CAST(nb + 1 AS BIGINT) AS n_second, CAST(na + nb + 3 AS BIGINT) AS n FROM pairs""")
def q_segment_ids(spark, sf_dir):
    """segment ids of the pair form (ones = second segment)."""
    s = _pairs(spark, sf_dir).withColumn("t", TX.segment_ids("a", "b"))
    return s.select("conv_id", "turn",
                    F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("n_second"),
                    F.size("t").cast("bigint").alias("n"))
