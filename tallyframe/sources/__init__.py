"""Sources and sinks: inline rows, files, workbooks, databases."""
