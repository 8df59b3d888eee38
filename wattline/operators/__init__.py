"""DataFrame -> DataFrame operators; every one takes ``keys`` and a time column."""
