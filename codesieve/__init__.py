"""Static analysis of Python sources as DataFrame queries."""

from .api import LintError, lint_directory, lint_file, lint_path
from .plans.lint import Config, lint
from .sources.scan import from_path, from_table

__version__ = "0.1.0"
__all__ = ["Config", "LintError", "from_path", "from_table", "lint", "lint_directory", "lint_file", "lint_path"]
