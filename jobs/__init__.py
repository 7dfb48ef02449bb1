"""Jobs to be run with spark-submit, each with a command line and a settings file."""
