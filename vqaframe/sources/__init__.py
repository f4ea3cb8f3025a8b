"""Sources and sinks: nested JSON, datasets, images, archives, metric lines."""
