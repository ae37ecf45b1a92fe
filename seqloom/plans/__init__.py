"""Plan shapes: durable intermediates and global order without a single-partition window."""
