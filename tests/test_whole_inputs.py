"""Queries without oracle read all rows."""

from __future__ import annotations

import re

import pytest

from evalkit.plans import catalog
from evalkit.plans.fixture import evals, positions
from evalkit.plans.texts import _answers


@pytest.mark.parametrize("name", ["legal_moves", "move_legality", "rescue_move", "validate_position", "planes", "prompts"])
def test_board_queries_take_all_positions(spark, sf, name):
    want = {r.position_id for r in positions(evals(spark, sf)).collect()}
    assert len(want) > 40
    assert {r.position_id for r in catalog.queries()[name](spark, sf).select("position_id").collect()} == want


@pytest.mark.parametrize("name", ["llm_stub_pipeline", "job_execution"])
def test_job_queries_take_all_jobs(spark, sf, name):
    want = {r.job_id for r in evals(spark, sf).collect()}
    assert len(want) > 400
    assert {r.job_id for r in catalog.queries()[name](spark, sf).select("job_id").collect()} == want


def test_answers_hold_whole_texts(spark, sf):
    """Each conversation's text, spaces aside, ends up whole in the answer and in its explanation."""
    texts = {(r.conv_id, r.turn): re.sub(r"\s+", " ", r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert max(map(len, texts.values())) > 40
    answers = {(r.conv_id, r.turn): r.answer for r in _answers(spark, sf).collect()}
    assert answers.keys() == texts.keys() and all(t in answers[k] for k, t in texts.items())
