from . import content, corpora, evaluation, retail, rules, samples, stateful, trajectory  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
