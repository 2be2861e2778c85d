"""All registered queries; importing the plan modules registers them."""

from postsift.plans import boards, dedup, landing, predicates, scalar, tracking  # noqa: F401
from postsift.plans.registry import ORACLES, QUERIES  # noqa: F401
