"""Relevance arithmetic for keyword search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from forumlens.schemas import BM25_B, BM25_K1, RECENCY_DECAY, RECENCY_SCALE_SECONDS


def inverse_document_frequency(documents: Column, matching: Column) -> Column:
    return F.log(1.0 + (documents - matching + 0.5) / (matching + 0.5))


def bm25(frequency: Column, length: Column, average_length: Column, idf: Column) -> Column:
    """Okapi BM25 weight of one term in one field; 0 where the term is absent."""
    relative = F.coalesce(length / F.nullif(average_length, F.lit(0.0)), F.lit(0.0))
    saturation = frequency + BM25_K1 * (1.0 - BM25_B + BM25_B * relative)
    weight = idf * (frequency * (BM25_K1 + 1.0)) / saturation
    return F.when(frequency > 0, weight).otherwise(F.lit(0.0))


def recency(date: Column, origin: Column) -> Column:
    """Halves with every scale length between date and origin; an unknown date does not decay."""
    age = F.abs(date - origin) / F.lit(float(RECENCY_SCALE_SECONDS))
    return F.coalesce(F.pow(F.lit(RECENCY_DECAY), age), F.lit(1.0))
