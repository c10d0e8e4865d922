"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from corpusmill.llm.ann import op6_nearest_neighbours
from corpusmill.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from corpusmill.llm.html_text import op7_html_text
from corpusmill.llm.language_id import op5_language_id
from corpusmill.llm.lexical_search import OP12_SQL, op12_lexical_search
from corpusmill.llm.metric_tree import OP13_SQL, op13_exact_topk
from corpusmill.llm.mixing import op3_source_mixing
from corpusmill.llm.ngram_join import op2_ngram_join
from corpusmill.llm.packing import op1_best_fit_packing
from corpusmill.llm.quality_classifier import op8_quality_classifier
from corpusmill.llm.quality_rules import op10_quality_rules
from corpusmill.llm.url_filter import OP4_SQL, op4_url_filter
from corpusmill.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_source_mixing": op3_source_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_html_text": op7_html_text,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_topk": op13_exact_topk,
}

ORACLES = {
    "op4_url_filter": OP4_SQL,
    "op9_warc": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_exact_topk": OP13_SQL,
}
