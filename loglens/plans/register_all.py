"""Import every catalog module so that all queries are registered."""

from . import catalog  # noqa: F401
from . import catalog_gc  # noqa: F401
from . import catalog_cases  # noqa: F401
from . import catalog_reports  # noqa: F401
from . import catalog_streams  # noqa: F401
from . import catalog_misc  # noqa: F401
from . import catalog_edges  # noqa: F401
