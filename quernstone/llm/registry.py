"""What ``__spark_entry__`` adds: the operators' queries and the pipeline."""

from quernstone.llm.oracles import ORACLES
from quernstone.llm.queries import QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
