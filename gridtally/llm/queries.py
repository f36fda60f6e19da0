"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from gridtally.llm.bpe import encode_documents
from gridtally.llm import secrets
from gridtally.llm.fingerprints import fingerprints
from gridtally.llm.html_text import extract_pages
from gridtally.llm.line_dedup import deletions
from gridtally.llm.mixing import mix_documents
from gridtally.llm.near_dedup import near_classes
from gridtally.llm.near_dedup import oracle as near_oracle
from gridtally.llm.neighbours import nearest
from gridtally.llm.quality import quality
from gridtally.llm.texts import table, vocabulary
from gridtally.llm.token_counts import count_tokens
from gridtally.llm.toxicity import score_documents, trained
from gridtally.llm.turns import oracle as turns_oracle
from gridtally.llm.turns import repair_report
from gridtally.llm.whitening import components


def op1_bpe(spark, sf_dir):
    """Digests of every document's ids and of its decoded text."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_tokens=False)


def op2_near_dedup(spark, sf_dir):
    """The contract of this query fixes shingles of four words."""
    return near_classes(table(spark, sf_dir, "documents"), width=4)


def op3_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_line_dedup(spark, sf_dir):
    """Every document's words deleted and the digest of what is left; none is dropped."""
    return deletions(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_html(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mix_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, trained(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark, sf_dir):
    return components(table(spark, sf_dir, "embeddings"))


def op12_nearest(spark, sf_dir):
    """The contract of this query fixes its queries: every vec_id divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), every=50)


def op13_turns(spark, sf_dir):
    return repair_report(table(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_bpe": op1_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op7_quality": op7_quality,
    "op8_html": op8_html,
    "op9_fingerprints": op9_fingerprints,
    "op6_mixing": op6_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_nearest": op12_nearest,
    "op13_turns": op13_turns,
}

ORACLES: dict[str, str] = {"op2_near_dedup": near_oracle(), "op5_secrets": secrets.oracle(), "op13_turns": turns_oracle()}
