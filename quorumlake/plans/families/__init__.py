"""Query families; importing this package registers all of them."""

from quorumlake.plans.families import scalars  # noqa: F401
from quorumlake.plans.families import relational  # noqa: F401
from quorumlake.plans.families import histories  # noqa: F401
from quorumlake.plans.families import resolution  # noqa: F401
from quorumlake.plans.families import policies  # noqa: F401
from quorumlake.plans.families import coverage  # noqa: F401
from quorumlake.plans.families import runtime  # noqa: F401
