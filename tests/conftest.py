from __future__ import annotations

import json
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gleaner import models  # noqa: E402
from gleaner.operators import graph  # noqa: E402
from gleaner.session import local  # noqa: E402
from gleaner.sources import corpus  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = local(4, 4, **{"spark.checkpoint.dir": f"file://{base}/checkpoints", "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def fresh():
    yield
    corpus.clear_corpora()
    graph.clear_graphs()
    models.reset_llm()
    models.configure_reranker(None)


class FakeLLM:
    """An endpoint that answers from a script and remembers what it was asked."""

    def __init__(self, replies):
        self.replies, self.asked = list(replies), []
        self.chat = SimpleNamespace(completions=SimpleNamespace(create=self.create))

    def create(self, **sent):
        self.asked.append(sent)
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        text = reply if isinstance(reply, str) else json.dumps(reply)
        if sent.get("stream"):
            return [SimpleNamespace(choices=[SimpleNamespace(delta=SimpleNamespace(content=text[i : i + 5]))]) for i in range(0, len(text), 5)]
        return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=text))])


@pytest.fixture
def fake_llm():
    def install(*replies):
        llm = FakeLLM(replies)
        models.set_client_factory(lambda **_: llm)
        models.configure_llm(model="scripted", base_url="http://localhost")
        return llm

    return install
