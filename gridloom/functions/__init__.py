"""See the package README for the list of operators in this subpackage."""
