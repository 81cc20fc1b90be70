"""Reading and writing what lies outside the store: files, exports, snapshots."""
