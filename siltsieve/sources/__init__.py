"""Where rows come from: folders of files, app lists, bins."""
