"""The subpackage's registered queries and their DuckDB text."""

from __future__ import annotations

from .chat import op7_chat_format
from .decontaminate import op1_decontamination
from .linededup import OP6_SQL, op6_line_dedup
from .mixing import OP5_SQL, op5_source_mixing
from .neardup import op3_ngram_join
from .nearest import op4_nearest
from .quality import op9_quality_rules
from .repair import op12_repair
from .repeats import op10_repeats
from .simhash import op11_simhash
from .toxicity import op2_toxicity
from .urlfilter import op8_url_filter
from .whitening import op13_whitening


def pipeline(spark, sf_dir: str):
    from corpus_pipeline import run
    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_toxicity, op3_ngram_join, op4_nearest, op5_source_mixing, op6_line_dedup, op7_chat_format,
    op8_url_filter, op9_quality_rules, op10_repeats, op11_simhash, op12_repair, op13_whitening,
    pipeline)}

SQL = {"op5_source_mixing": OP5_SQL, "op6_line_dedup": OP6_SQL}
