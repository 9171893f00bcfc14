"""Identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_id(*parts: Column) -> Column:
    """The first 8 bytes of the SHA-256 of the parts joined by ``::``, without the sign bit."""
    text = F.concat_ws("::", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def term_index(term: Column) -> Column:
    """The first 4 bytes of the SHA-1 as an unsigned number."""
    return F.conv(F.substring(F.sha1(term), 1, 8), 16, 10).cast("bigint")


def parent_id(title: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit(":"), text)), 1, 16)


def document_collection(company: Column, source: Column, agent: Column) -> Column:
    """docling_{company}; for sources other than "general" also the source and, if given, the agent."""
    base = F.concat(F.lit("docling_"), company)
    agent_part = F.when(F.coalesce(agent, F.lit("")) != "", F.concat(F.lit("_"), agent)).otherwise("")
    return F.when(source == "general", base).otherwise(F.concat(base, F.lit("_"), source, agent_part))


def sendable_collection(company: Column) -> Column:
    return F.concat(F.lit("sendable_files_"), company)
