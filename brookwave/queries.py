"""The library's queries by name, and the SQL that each must equal."""

from __future__ import annotations

from brookwave.plans import containers, decoding, fragmented, rules, signals, streams, studies

QUERIES: dict = streams.QUERIES | signals.QUERIES | studies.QUERIES | containers.QUERIES | rules.QUERIES | fragmented.QUERIES | decoding.QUERIES
SQL: dict = streams.SQL | signals.SQL | studies.SQL | containers.SQL | rules.SQL | fragmented.SQL | decoding.SQL
