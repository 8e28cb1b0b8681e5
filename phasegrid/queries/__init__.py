"""Named queries over the driver's tables, each with independent SQL where SQL can express it."""

from phasegrid.queries import geometry, inversion, layers, network, series, trends  # noqa: F401
from phasegrid.queries.cubes import QUERIES, SQL  # noqa: F401
