"""Column-expression builders (JVM-side, codegen friendly)."""

from quire.functions.text import *  # noqa: F401,F403
from quire.functions.ids import *  # noqa: F401,F403
