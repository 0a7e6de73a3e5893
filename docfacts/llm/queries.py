"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from docfacts.llm import fingerprints, interpolation, language, maxscore, minhash, mixing, quality, sentencepiece, sharding, substrings


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1,
        "op2_top_k": maxscore.op2,
        "op3_sentencepiece": sentencepiece.op3,
        "op4_interpolation": interpolation.op4,
        "op5_fingerprints": fingerprints.op5,
        "op6_substrings": substrings.op6,
        "op7_language": language.op7,
        "op8_quality": quality.op8,
        "op9_near_duplicates": minhash.op9,
        "op10_mixing": mixing.op10,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": maxscore.OP2_SQL, "op6_substrings": substrings.OP6_SQL, "op9_near_duplicates": minhash.OP9_SQL, "op10_mixing": mixing.OP10_SQL}
