"""Queries over the given tables, and their SQL where it can say the same."""

from pulsemill.llm import (conversations, decontamination, line_dedup, near_dup, packing, perplexity, pivots, quality_rules,
                           spelling, templates, token_files, tokens, toxicity, url_rules)
from pulsemill.sources.storage import scratch_path

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_toxicity")
def op1(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_sentences",
        "worst_sentence")


@query("op2_token_files")
def op2(spark, d):
    root = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, d, "documents"), root, tokens.tokenizer_path())
    return token_files.read_token_files(spark, root)


@query("op3_near_dup")
def op3(spark, d):
    return near_dup.link(table(spark, d, "documents"))


@query("op4_url_rules", url_rules.judge_sql())
def op4(spark, d):
    return url_rules.judge(table(spark, d, "pages"))


@query("op5_decontamination")
def op5(spark, d):
    return decontamination.digest(
        decontamination.find(table(spark, d, "documents"), table(spark, d, "benchmark")))


@query("op6_quality_rules", quality_rules.judge_sql())
def op6(spark, d):
    return quality_rules.judge(table(spark, d, "documents"))


@query("op7_line_dedup")
def op7(spark, d):
    return line_dedup.drop_recurring(table(spark, d, "documents"))


@query("op8_templates")
def op8(spark, d):
    return templates.extract(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


@query("op9_perplexity")
def op9(spark, d):
    return perplexity.classify(table(spark, d, "documents"), table(spark, d, "labels")).select(
        "doc_id", "lang", "perplexity", "perplexity_limit", "kept")


@query("op10_packing")
def op10(spark, d):
    return packing.pack(table(spark, d, "documents"), tokens.tokenizer_path())


@query("op11_conversations")
def op11(spark, d):
    return conversations.digest(conversations.damaged(table(spark, d, "conversations")))


@query("op12_pivots", pivots.link_sql())
def op12(spark, d):
    return pivots.link(table(spark, d, "embeddings"))


@query("op13_spelling")
def op13(spark, d):
    return spelling.group(table(spark, d, "documents"), faults=199).select(
        "word", "form", "root", "n", "n_near", "form_n")
