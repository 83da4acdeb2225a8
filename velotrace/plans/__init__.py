"""See the README for what this subpackage holds."""

from . import network, relational, singles, spatial, storage, trajectory  # noqa: F401  (they register their queries)
