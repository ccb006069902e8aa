"""The operators that follow a stream: deduplicated change logs, windowed activity, bounded logs."""
