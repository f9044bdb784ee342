"""Sources and sinks: source trees, style sheets, token documents, change feeds, captures, configuration."""
