"""A target that gives up in the middle of a task."""

from bindery.targets import FilesTarget


class Broken(FilesTarget):
    def put(self, workspace, name, content):
        if workspace == "b" and name == "2.md":
            raise RuntimeError("the store is gone")
        super().put(workspace, name, content)
