"""The query catalogue."""

from emberline.plans import built, code, corpus, episodes, functions, records, rollouts, training

QUERIES = {k: v for m in (episodes, corpus, training, functions, records, rollouts, built) for k, v in m.CATALOGUE.queries.items()} | code.QUERIES
SQL = {k: v for m in (episodes, corpus, training, functions, records, rollouts, built) for k, v in m.CATALOGUE.sql.items()}
