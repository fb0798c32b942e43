"""Operators for large-scale training data, each a Spark job over a table.

Nothing else in the library imports this subpackage.
"""

from pyspark import cloudpickle as _pickle

from . import (
    common,
    decontam,
    html_main,
    metric_join,
    mixture,
    near_dup,
    prefix_trie,
    quality,
    secrets,
    substrings,
    tokens,
    toxicity,
    urls,
    whitening,
)

# Functions that run on the executors are sent there whole, with what they use.
for _module in (
    common, html_main, metric_join, near_dup, prefix_trie, quality, secrets, substrings, tokens,
    toxicity, urls, whitening,
):
    _pickle.register_pickle_by_value(_module)

__all__ = [
    "common",
    "decontam",
    "html_main",
    "metric_join",
    "mixture",
    "near_dup",
    "prefix_trie",
    "quality",
    "secrets",
    "substrings",
    "tokens",
    "toxicity",
    "urls",
    "whitening",
]
