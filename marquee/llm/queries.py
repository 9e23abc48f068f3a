"""The registered queries over the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from marquee.llm.common import crc_remainder, table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> bytes:
    """Content of a public tokenizer's file, read where the driver runs."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op1_toxicity(spark, sf_dir):
    from marquee.llm import toxicity
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"), fold=3)
    out = toxicity.score(docs, model, threshold=0.7)
    return out.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")


@query
def op4_language(spark, sf_dir):
    from marquee.llm import language
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train_on(docs, fold=5))
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op2_nearest_neighbours(spark, sf_dir):
    from marquee.llm.ann import nearest
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


@query
def op3_packing(spark, sf_dir):
    from marquee.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_TOKENIZER).decode(), size=2048, end_id=1)


@query
def op6_token_counts(spark, sf_dir):
    from marquee.llm.tokens import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_TOKENIZER), limit=4096)


@query
def op9_token_files(spark, sf_dir):
    from marquee.llm.binary import ids_digest, write_ids
    return ids_digest(*write_ids(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_TOKENIZER).decode(), end_id=0))


@query
def op5_mixing(spark, sf_dir):
    from marquee.llm.mixing import mix, repeating
    out = mix(table(spark, sf_dir, "documents"), weights=repeating((5, 2, 1)), repeats=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op7_vector_duplicates(spark, sf_dir):
    from marquee.llm.vectors import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query
def op8_chat_formatting(spark, sf_dir):
    """Chosen: each conversation; rejected: the same with its last reply swapped (``swapped_replies``)."""
    from marquee.llm.chat import format_preferences, span_text, swapped_replies
    conversations = table(spark, sf_dir, "conversations")
    out = format_preferences(conversations, swapped_replies(conversations))
    return out.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected",
                      span_text("chosen_spans").alias("chosen_spans"), span_text("rejected_spans").alias("rejected_spans"))


@query
def op10_jaccard_join(spark, sf_dir):
    from marquee.llm.shingles import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op11_exact_dedup(spark, sf_dir):
    from marquee.llm.exact import exact_duplicates
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_conversation_trie(spark, sf_dir):
    from marquee.llm.trie import prefix_trie
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op13_tokenizer_alignment(spark, sf_dir):
    from marquee.llm.align import alignment
    return alignment(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_TOKENIZER).decode(), tokenizer_file(PIECE_TOKENIZER))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def _oracles() -> None:
    from marquee.llm import chat, exact, trie
    ORACLE["op8_chat_formatting"] = chat.ORACLE
    ORACLE["op11_exact_dedup"] = exact.ORACLE
    ORACLE["op12_conversation_trie"] = trie.ORACLE


_oracles()
