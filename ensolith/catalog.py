"""All registered queries of the library proper, with their SQL."""

from ensolith.plans import budgets, calibration, checks, contrasts, designs, evaluation, knowledge, records, search, sequences, studies, texts, transforms  # noqa: F401  they register themselves
from ensolith.plans.registry import ORACLES, QUERIES  # noqa: F401
