"""All queries of the library's core and the SQL they are checked against."""

from stroma.plans import autoregression as _autoregression  # noqa: F401
from stroma.plans import composite as _composite  # noqa: F401
from stroma.plans import forecasts as _forecasts  # noqa: F401
from stroma.plans import inference as _inference  # noqa: F401
from stroma.plans import models as _models  # noqa: F401
from stroma.plans import ordered as _ordered  # noqa: F401
from stroma.plans import profiles as _profiles  # noqa: F401
from stroma.plans import relational as _relational  # noqa: F401
from stroma.plans import robust as _robust  # noqa: F401
from stroma.plans import rollout as _rollout  # noqa: F401
from stroma.plans import study as _study  # noqa: F401
from stroma.plans import variants as _variants  # noqa: F401
from stroma.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
