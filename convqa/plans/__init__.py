from convqa.plans import calls, conversation, files, knowledge, scoring, talkover  # noqa: F401
from convqa.plans.registry import ORACLES, QUERIES  # noqa: F401
